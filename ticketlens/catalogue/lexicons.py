"""Words that occur in the test tables.

Their text is made up, so ordinary support words are absent; the rules below
are chosen so that every class of every rule occurs.
"""

NEGATIVE = ("trash", "idiot", "clown", "scum", "worthless", "moron", "pathetic", "loser", "stupid", "disgusting", "éque")
POSITIVE = ("here", "license", "für")
ABUSIVE = NEGATIVE

TYPES = (
    ("Billing and Payments", ("token",)),
    ("Technical Support", ("license", "scum")),
    ("Account & Access", ("here", "clown")),
    ("Shipping & Returns", ("mit", "avec", "con")),
    ("Product Inquiry", ("from", "das", "por", "une")),
)
PRIORITIES = (
    ("high", ("stupid", "idiot", "sur", "von")),
    ("medium", ("for", "pas", "ein", "las")),
)
