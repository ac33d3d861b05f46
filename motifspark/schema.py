"""Names and sentinel values that several operators share. Fixed values of the data model."""

UNLABELED = "UNLABELED"
OUTLIER = "__OUTLIER__"
REJECTED_BY_STAGE1 = "__REJECTED_BY_STAGE1__"
UNKNOWN_CLUSTER = "UNKNOWN_CLUSTER"
INVALID_TEMPLATE = "__INVALID_TEMPLATE__"
NEGATIVE = "NEGATIVE"
NON_MEME, TEMPLATE_FREE, TEMPLATED = "Non-Meme", "Template-Free", "Templated-Meme"
REJECT_TOKENS = [OUTLIER, REJECTED_BY_STAGE1, UNKNOWN_CLUSTER, INVALID_TEMPLATE]
TRAIN_SOURCE = "imgflip_train"
