"""Alphabets, thresholds, word lists and tables that define the results."""

# Residues, in alphabetical order of their one-letter codes.
RESIDUES = "ACDEFGHIKLMNPQRSTVWY"
SPECIES = "HomoSapiens"
MIN_SEQUENCE = 6

# Consensus anchors.
ANCHOR_SHARE = 0.80
ANCHOR_MAX = 8
ANCHOR_SUPPORT = 20
ANCHOR_USABLE = 3
ANCHOR_FULL = 4
ANCHOR_MIN_J = 2
TRAILING = 2

# N-gram enrichment.
GRAM_FLOOR = 20
FDR = 0.01
STUDY_FLOOR = 200
FOCUS = [
    ("GILGFVFTL", "Influenza A (M1)"),
    ("NLVPMVATV", "CMV (pp65)"),
    ("GLCTLVAML", "EBV (BMLF1)"),
]

# Bigram language models.
SEED = 20260727
MIN_REGION = 3
ADD_K = 0.5
CONDITIONED_SHARE = 0.7
PAIR_FLOOR = 20
LENGTH_SLOTS = 40
DECOY_TRIES = 10
GAP_RESAMPLES = 200
# Places of the interval's ends among the sorted resamples, from 0.
GAP_PLACES = (5, 195)
TRIMS = [
    ("none", 0, 0),
    ("both ends, 1", 1, 1),
    ("both ends, 2", 2, 2),
    ("both ends, 3", 3, 3),
    ("5' end, 1", 1, 0),
    ("5' end, 2", 2, 0),
    ("3' end, 1", 0, 1),
    ("3' end, 2", 0, 2),
]

# Held-out group experiments.
HASH_BITS = 18
EPOCHS = 3
LEARNING_RATE = 0.08
L2 = 1e-6
EPITOPE_CAP = 800
EPITOPE_FLOOR = 150
EPITOPES = 20
FOLDS = 5
SEEDS = 5
CONTROL_SEEDS = 3
CONTROL_PASS = 0.65
CROSS_CAP = 14
REGION_LENGTH_CAP = 12
EPITOPE_CLASS_FLOOR = 30
MEAN_RESAMPLES = 2000
MEAN_PLACES = (50, 1949)

# Paired-chain benchmark.
NEGATIVES = 5
NEAR_EDITS = 3
BENCHMARK_CROSS_CAP = 16
BENCHMARK_SUPPORT = 10
MAX_FPR = 0.1
PEPTIDE_RESAMPLES = 5000
LOOPS = ["CDR1a", "CDR2a", "CDR3a", "CDR1b", "CDR2b", "CDR3b"]
LOOP_TAGS = ["A1", "A2", "A3", "B1", "B2", "B3"]
LOOP_WEIGHTS = [1, 1, 3, 1, 1, 3]
WIDTH_CAPS = {"A1": 7, "A2": 8, "A3": 22, "B1": 6, "B2": 7, "B3": 23, "peptide": 12}
VALIDATION_SHARE = 0.20
SCHEMES = ["challenge", "random", "hard", "matched"]
FRACTIONS = [0.10, 0.20, 0.35, 0.50, 0.75, 1.00]
CURVE_SEEDS = 2
CURVE_GROUP_FLOOR = 20

# Text checks.
BULLET_CHARS = 85
BULLETS_LEAST = 3
BULLETS_MOST = 5
BULLET_EXCLUDED = ["Bullet", "If the journal", "Avoid the"]

# Hand-made germline tables of the first, superseded parse: residues by gene.
HAND_V = {
    "TRBV2": "CASS",
    "TRBV4-1": "CASS",
    "TRBV4-2": "CASS",
    "TRBV4-3": "CASS",
    "TRBV5-1": "CASS",
    "TRBV5-6": "CASS",
    "TRBV5-8": "CASS",
    "TRBV6-1": "CASS",
    "TRBV6-2": "CASS",
    "TRBV6-4": "CASS",
    "TRBV6-5": "CASS",
    "TRBV6-6": "CASS",
    "TRBV7-2": "CASS",
    "TRBV7-6": "CASS",
    "TRBV7-8": "CASS",
    "TRBV7-9": "CASS",
    "TRBV9": "CASS",
    "TRBV10-3": "CASS",
    "TRBV11-2": "CASS",
    "TRBV12-3": "CASS",
    "TRBV12-4": "CASS",
    "TRBV13": "CASS",
    "TRBV14": "CASS",
    "TRBV15": "CATS",
    "TRBV19": "CASS",
    "TRBV19-1": "CASS",
    "TRBV20-1": "CSAR",
    "TRBV24-1": "CATS",
    "TRBV25-1": "CASS",
    "TRBV27": "CASS",
    "TRBV28": "CASS",
    "TRBV29-1": "CSVG",
    "TRBV30": "CAWS",
}
HAND_J = {
    "TRBJ1-1": "TEAFF",
    "TRBJ1-2": "YGYTF",
    "TRBJ1-3": "NTIYF",
    "TRBJ1-4": "NEKLF",
    "TRBJ1-5": "QPQHF",
    "TRBJ1-6": "SPLYF",
    "TRBJ2-1": "NEQFF",
    "TRBJ2-2": "GELFF",
    "TRBJ2-3": "DTQYF",
    "TRBJ2-4": "KNIQYF",
    "TRBJ2-5": "ETQYF",
    "TRBJ2-6": "NVLTF",
    "TRBJ2-7": "YEQYF",
}
