"""Schemas of the case tables (all keyed by ``dossier_id``)."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(),
    "strings": T.ArrayType(T.StringType()), "map": T.MapType(T.StringType(), T.StringType()),
}


def _schema(**columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in columns.items()])


PAGES = _schema(
    dossier_id="string", numero_global="int", fichier_source="string", page_fichier="int", texte="string",
    ocr_applique="boolean", empreinte_sha256="string", cote_detectee="string", statut="string",
)
PIECES = _schema(
    dossier_id="string", piece_id="int", type="string", page_debut="int", page_fin="int", date_apparente="string",
    heure_apparente="string", service_redacteur="string", personnes_citees="strings", cote="string",
    confiance="double", statut_revision="string", personne_principale_id="string",
    methode_personne_principale="string", titre="string",
)
PERSONNES = _schema(
    dossier_id="string", personne_id="string", nom="string", role="string", alias="strings", est_client="boolean",
)
ACTES = _schema(
    dossier_id="string", acte_id="int", piece_id="int", date="string", heure="string", nature="string",
    personne_id="string", service="string", page="int", citation="string", methode_verif="string", details="map",
    statut_verif="string",
)
DEFAULTS = {"est_client": False, "statut": "ingere", "ocr_applique": False, "confiance": 0.0}
DETAILS = ("agent", "avocat", "interprete", "presentation", "assentiment", "autorisation_juge", "cadre")
