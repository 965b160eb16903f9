"""Column names, types and labels of receipt data."""

from __future__ import annotations

from pyspark.sql import types as T

# Raw point-of-sale columns and the names used from here on.
RAW_TO_CANONICAL = {
    "scontrinoIdentificativo": "receipt_id",
    "totaleLordo": "line_total",
    "quantitaPeso": "weight",
    "negozioCodice": "store_id",
    "scontrinoData": "date_str",
    "scontrinoOra": "time_str",
    "articoloCodice": "product_id",
    "cassiereCodice": "cashier_id",
    "formaPagamentoCodice": "payment_method_code",
    "totaleSconti": "total_discounts",
    "puntiRitiro": "points_redeemed",
}
# Raw flag columns and the names of the parsed flags.
RAW_FLAGS = {
    "abortito": "is_abort",
    "storno": "is_item_void",
    "annullo": "is_void",
    "omaggio": "is_gift",
}
RAW_SELF_SCAN = "selfScanning"

RAW_SCHEMA = T.StructType(
    [
        T.StructField("scontrinoIdentificativo", T.StringType()),
        T.StructField("articoloCodice", T.StringType()),
        T.StructField("totaleLordo", T.DoubleType()),
        T.StructField("quantitaPeso", T.DoubleType()),
        T.StructField("negozioCodice", T.StringType()),
        T.StructField("scontrinoData", T.StringType()),
        T.StructField("scontrinoOra", T.StringType()),
        T.StructField("cassiereCodice", T.StringType()),
        T.StructField("formaPagamentoCodice", T.StringType()),
        T.StructField("totaleSconti", T.DoubleType()),
        T.StructField("puntiRitiro", T.DoubleType()),
        T.StructField("selfScanning", T.StringType()),
        T.StructField("abortito", T.StringType()),
        T.StructField("storno", T.StringType()),
        T.StructField("annullo", T.StringType()),
        T.StructField("omaggio", T.StringType()),
    ]
)

# Fixed value: payment code of cash.
CASH_CODE = "01"

# Shopping missions and their report labels.
B2B = "B2B / Bulk Outlier"
STOCK_UP = "Weekly Stock-up"
FRESH_PICK = "Daily Fresh Pick"
PREMIUM = "Premium/Specialty Single-Item"
QUICK = "Quick Convenience"
STANDARD = "Standard Mixed Trip"
MISSION_LABELS = {
    STANDARD: "Spesa Standard Mista",
    PREMIUM: "Premium / Specialità Singolo Articolo",
    B2B: "B2B / Ingrosso Outlier",
    STOCK_UP: "Spesa Settimanale di Scorta",
    QUICK: "Convenienza Rapida",
    FRESH_PICK: "Fresco Quotidiano",
}

# Field names of the three reports.
MISSION_REPORT_NAMES = {
    "shopping_mission": "Missione Spesa",
    "receipt_count": "Numero Scontrini",
    "total_mission_revenue": "Fatturato Totale Missione",
    "avg_trip_value": "Valore Medio Spesa",
    "avg_items_per_trip": "Media Articoli per Spesa",
    "revenue_share_pct": "Percentuale Fatturato",
    "traffic_share_pct": "Percentuale Traffico",
}
INTEGRITY_REPORT_NAMES = {
    "cashier_id": "Codice Cassiere",
    "cashier_sweethearting_anomaly_score": "Score Anomalia Sweethearting",
    "cashier_sweethearting_z_score": "Z-Score Deviazione",
}
BEHAVIOR_REPORT_NAMES = {
    "cashier_id": "Codice Cassiere",
    "risk_score": "Score Rischio Comportamentale",
    "cash_reliance_ratio": "Indice Uso Contanti",
    "void_rate_per_receipt": "Tasso Storni",
    "total_markdowns": "Totale Sconti e Ribassi",
    "total_voids": "Totale Articoli Stornati",
    "captured_revenue": "Fatturato Acquisito",
    "leakage_pct": "Percentuale Perdita (Leakage)",
}
# What the fields of the reports mean.
FIELD_NOTES = {
    "periodo": "Mese o anno a cui si riferiscono le righe.",
    "Missione Spesa": "Tipo di spesa assegnato allo scontrino.",
    "Numero Scontrini": "Scontrini con questa missione.",
    "Fatturato Totale Missione": "Somma dei valori di questi scontrini.",
    "Valore Medio Spesa": "Valore medio di uno di questi scontrini.",
    "Media Articoli per Spesa": "Righe per scontrino, in media.",
    "Percentuale Fatturato": "Parte del fatturato del periodo, in percento.",
    "Percentuale Traffico": "Parte degli scontrini del periodo, in percento.",
    "Codice Cassiere": "Codice di chi sta alla cassa.",
    "Score Anomalia Sweethearting": "-1 se gli sconti superano quelli dei colleghi, altrimenti 0.",
    "Z-Score Deviazione": "Distanza dalla media dei colleghi, in deviazioni standard.",
    "Score Rischio Comportamentale": "Somma pesata delle distanze dal comportamento medio.",
    "Indice Uso Contanti": "Parte degli scontrini pagati in contanti.",
    "Tasso Storni": "Righe stornate per scontrino.",
    "Totale Sconti e Ribassi": "Somma degli sconti concessi.",
    "Totale Articoli Stornati": "Numero di righe stornate.",
    "Fatturato Acquisito": "Somma delle righe registrate.",
    "Percentuale Perdita (Leakage)": "Sconti divisi per fatturato.",
}

# Metrics checked for suspicious zeros, with their business names.
CHECKED_METRICS = {
    "basket_value": "Fatturato (Basket Value)",
    "freshness_weight_ratio": "Incidenza Peso Freschissimi",
    "freshness_value_ratio": "Incidenza Valore Freschissimi",
    "leakage_pct": "Percentuale Perdita (Leakage)",
    "void_rate_per_receipt": "Tasso Storni",
    "total_voids": "Totale Articoli Stornati",
}
# Which area suffers when one of these metrics is all zero.
MISSION_METRICS = ("basket_value", "freshness_weight_ratio", "freshness_value_ratio")
RISK_METRICS = ("leakage_pct", "void_rate_per_receipt", "total_voids")

MISSION_FEATURES = ("basket_size", "basket_value_per_item", "freshness_weight_ratio")
