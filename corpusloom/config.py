"""Parameters of the curation flows with their default values."""

from __future__ import annotations

# Words that select a case, tried as case-insensitive substrings.
DOMAIN_TERMS = [
    "melanoma", "melanocítico", "melanocitico", "nevus", "nevo melanocítico", "nevo melanocitico",
    "carcinoma basocelular", "carcinoma basal", "carcinoma espinocelular", "carcinoma escamoso cutáneo",
    "queratosis actínica", "queratosis actinica", "queratosis seborreica", "dermatofibroma", "angioma", "hemangioma",
    "lesión pigmentada", "lesion pigmentada", "dermatoscopia", "dermatoscopía",
    "lesión cutánea sospechosa", "lesion cutanea sospechosa",
]
# Words that suggest an urgent case.
URGENT_TERMS = ["melanoma", "carcinoma basocelular", "carcinoma espinocelular", "carcinoma escamoso cutáneo", "queratosis actínica", "maligno"]
# Code prefix -> category and label.
CODE_PREFIXES = {
    "c43": ("mel", "urgente"), "d03": ("mel", "urgente"), "c44": ("bcc", "urgente"), "d04": ("akiec", "urgente"),
    "l57": ("akiec", "urgente"), "d22": ("nv", "no_urgente"), "d23": ("df", "no_urgente"), "l82": ("bkl", "no_urgente"),
}
# Category -> label, label -> id.
CATEGORY_LABELS = {
    "mel": "urgente", "akiec": "urgente", "bcc": "urgente", "bkl": "no_urgente", "nv": "no_urgente", "df": "no_urgente", "vasc": "no_urgente",
}
LABEL_IDS = {"no_urgente": 0, "urgente": 1}
# Words whose fragmentation by tokenizers is looked at.
KEY_TERMS = ["asimetría", "melanoma", "queratosis", "dermatofibroma", "carcinoma", "basocelular", "nevus", "vascular", "escamosa", "perlado", "descamativa"]
# Columns that reviewers fill in.
REVIEW_COLUMNS = ["es_realmente_dermatologico", "categoria_ham10000_similar", "etiqueta_urgencia_final", "revisado_por", "notas"]

MANUAL_LABEL, URGENT_LABEL = "revisar_manual", "urgente"
TEXT_CHARS = 1500
SEED = 42
PER_CATEGORY = 18
TRAIN_SHARE, VAL_SHARE = 0.7, 0.15
MAX_TOKENS = 128
GOALS = {"recall": 0.85, "f1_macro": 0.75}
HYPERPARAMETERS = {"features": 1 << 12, "max_iter": 20, "reg_param": 0.01, "max_length": MAX_TOKENS, "seed": SEED}
# Rank, alpha, dropout, rate, epochs, batch and length of the adapter; the size of the base and the rows scored at once are this library's own.
ADAPTER = {
    "rank": 8, "alpha": 16, "dropout": 0.05, "learning_rate": 2e-4, "epochs": 15, "batch_size": 8, "max_length": MAX_TOKENS,
    "features": 1 << 12, "hidden": 32, "score_rows": 8,
}
