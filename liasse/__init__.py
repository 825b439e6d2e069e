"""liasse: case-file analytics as Spark jobs.

Every table carries ``dossier_id`` and every operator is a plain function from
DataFrames to a DataFrame that runs over all cases at once.
"""
