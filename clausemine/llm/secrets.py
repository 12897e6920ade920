"""Secret scans: strict patterns, and sliding-window entropy over candidate strings.

A candidate is an unbroken run of 20 or more base64-like characters with a digit and a letter that no
strict match covers. It belongs to the narrowest character class that holds it: hex, upper case with
digits, or base64. A window of 20 characters slides over it; per step only the counts of the
character that leaves and the one that enters change, and with them the sum of c*log2(c), from which
the window's Shannon entropy follows. A candidate whose highest window reaches its class's threshold is
a secret unless the allow-list suppresses it (ids of known form, dotted numbers, word-like runs,
checksum fields). Of a candidate that begins as a lower-case path, the windows inside that path do not
count, all others do; repetitive runs need no rule, as their windows stay below every threshold.

Everything is DataFrame functions in one pass over the rows, no shuffle.

Defined results: null or empty text has no spans; repeated rows, null doc_ids and empty tables are
plain rows or none; other columns are ignored.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import table, texts
from .spans import let, located, overlaps

KINDS = ("assign", "access", "hex", "entropy")
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
WINDOW = 20
#: Character classes, narrowest first: name, pattern, entropy in bits that a window of 20 must reach.
CLASSES = (
    ("hex", "^[0-9a-fA-F]+$", 3.1),
    ("upper", "^[A-Z0-9]+$", 3.5),
    ("base64", "^[A-Za-z0-9+/_=-]+$", 3.8),
)
#: The characters of the widest class.
LETTERS = string.ascii_letters + string.digits + "+/_=-"
NUMBERS = [LETTERS.index(chr(i)) if chr(i) in LETTERS else len(LETTERS) for i in range(128)]
FIELDS = 10
LONGS = len(LETTERS) // FIELDS + 1
#: A word or number of a path, and a part of it: shorter than a window, or words and numbers, or digits alone, or an id.
STEP = "(?:[a-z]++[0-9]{0,4}+|[0-9]{1,4}+)"
PART = rf"(?:(?![a-z0-9_-]{{{WINDOW}}})[a-z0-9_-]++|{STEP}(?:[_-]{STEP})*+|[0-9_-]++|[0-9a-f]{{8}}(?:-[0-9a-f]{{4}}){{3}}-[0-9a-f]{{12}})"
#: The lower-case path that a candidate begins with. Groups are possessive here and below, as Java recurses once per repeat of others.
PATH = f"^/?(?:{PART}/){{2,}}+(?:{PART}$)?+"
#: Allow-list, fixed values: forms of a whole candidate that look random and are no secrets.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9+/_=-]+$",
    r"^[A-Za-z]++(?:[_-][A-Za-z]++)*+[_-]?[0-9]{1,4}$",
    r"(?i)^sha(1|256|512)[-_=]",
)
ALLOWED_BEFORE = r"(?i)(sha-?1|sha-?256|sha-?512|md5|checksum|integrity|commit|revision|etag)\W{0,4}$"


def codes(word: Column) -> Column:
    """Each character's number among ``LETTERS`` (others share the last number)."""
    return F.transform(F.split(word, ""), lambda c: F.coalesce(F.get(F.array(*map(F.lit, NUMBERS)), F.ascii(c)), F.lit(len(LETTERS))))


def window_entropy(numbers: Column, window: int = WINDOW) -> Column:
    """The highest entropy (bits a character) of any window over a bound array of codes, by incremental counts; shorter ones are one window.

    The counts of all characters are fields of six bits in a few longs, so a step costs the same however many characters
    there are. c * log2(c) comes from a table of ``window + 1`` numbers.
    """
    n = F.size(numbers)
    size = F.least(F.lit(window), n)
    terms = F.array(*(F.lit(c * math.log2(c) if c > 1 else 0.0) for c in range(window + 2)))
    one = [F.array(*(F.lit(1 << 6 * (i % FIELDS) if i // FIELDS == k else 0).cast("long") for i in range(len(LETTERS) + 1)), F.lit(0).cast("long")) for k in range(LONGS)]
    slot, shift = (F.array(*(F.lit(f(i)) for i in range(len(LETTERS) + 1))) for f in (lambda i: i // FIELDS, lambda i: 6 * (i % FIELDS)))
    count = lambda acc, c: F.call_function("shiftright", F.get(acc["counts"], F.get(slot, c)), F.get(shift, c)).bitwiseAND(63).cast("int")
    nothing = F.lit(len(LETTERS) + 1)
    start = F.struct(F.array(*[F.lit(0).cast("long")] * LONGS).alias("counts"), F.lit(0.0).alias("total"), F.lit(0.0).alias("best"))

    def step(acc, i):
        came, gone = F.get(numbers, i - 1), F.when(i > size, F.get(numbers, i - size - 1))
        c = count(acc, came)
        d = F.when(gone.isNotNull(), count(acc, gone) + F.when(gone == came, 1).otherwise(0)).otherwise(1)  # one occurrence weighs nothing, so none that leaves counts as one
        counts = F.array(*(F.get(acc["counts"], F.lit(k)) + F.get(one[k], came) - F.get(one[k], F.coalesce(gone, nothing)) for k in range(LONGS)))
        total = acc["total"] + F.get(terms, c + 1) - F.get(terms, c) + F.get(terms, d - 1) - F.get(terms, d)
        return let(total, lambda t: F.struct(counts.alias("counts"), t.alias("total"), F.when(i >= size, F.greatest(acc["best"], F.log2(size.cast("double")) - t / size)).otherwise(acc["best"]).alias("best")))

    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), start, step, lambda acc: acc["best"])).otherwise(0.0)


def tagged(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("k"), s["end"].alias("end")))


def base_spans(text: Column) -> Column:
    """The strict matches that pass, a sorted array for each kind: ``struct<assign, access, hex>``."""
    low = F.lower(text)
    named = low.contains(KEYWORDS[0])
    for word in KEYWORDS[1:]:
        named = named | low.contains(word)
    assigned = F.filter(located(text, ASSIGN, named), lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 1)) >= 6)
    access = F.filter(located(text, ACCESS, text.contains("AKIA")), lambda s: F.length(s["match"]) >= 20)
    return F.struct(tagged(assigned, "assign").alias("assign"), tagged(access, "access").alias("access"), tagged(located(text, HEX), "hex").alias("hex"))


def entropy_spans(text: Column, base: Column, window: int = WINDOW) -> Column:
    """Candidates above their class's threshold that neither a base span (of a bound ``base``) covers nor the allow-list suppresses."""
    allowed = lambda m: F.greatest(*(m.rlike(p) for p in ALLOWED))
    path = lambda s: F.char_length(F.regexp_extract(s["match"], PATH, 0))

    def plausible(s):
        m = s["match"]
        free = ~(overlaps(base["assign"], s) | overlaps(base["access"], s) | overlaps(base["hex"], s))
        return m.rlike("[0-9]") & m.rlike("[A-Za-z]") & free & ~allowed(m) & ~s["left"].rlike(ALLOWED_BEFORE)

    def random(s):
        """What is judged, all windows that leave the path, is cut out once and not for each step."""
        least = F.lit(None).cast("double")
        for _, pattern, bits in reversed(CLASSES):
            least = F.when(s["match"].rlike(pattern), bits).otherwise(least)
        rest = lambda n: F.substring(s["match"], F.greatest(F.lit(1), n - window + 2), F.char_length(s["match"]))
        return let(path(s), lambda n: (n < F.char_length(s["match"])) & let(codes(rest(n)), lambda numbers: F.coalesce(window_entropy(numbers, window) >= least - 1e-9, F.lit(False))))

    return tagged(F.filter(F.filter(located(text, CANDIDATE), plausible), random), "entropy")


def written(spans: Column) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["k"]), s["start"].cast("string"), s["end"].cast("string"))))


def secret_scan(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex (base spans), base_sha256, spans, n_entropy."""
    both = lambda b: F.struct(F.array_sort(F.concat(b["assign"], b["access"], b["hex"])).alias("base"), entropy_spans(F.col("text"), b, window).alias("more"))
    rows = texts(docs).select("doc_id", let(base_spans(F.col("text")), both).alias("spans")).select("doc_id", "spans.*")
    count = lambda k: F.size(F.filter("base", lambda s: s["k"] == k)).cast("long")
    return rows.select(
        "doc_id",
        *(count(i).alias(f"n_{kind}") for i, kind in enumerate(KINDS[:3])),
        F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        written(F.array_sort(F.concat("base", "more"))).alias("spans"),
        F.size("more").cast("long").alias("n_entropy"),
    )


def op2_secrets(spark, sf_dir):
    return secret_scan(table(spark, sf_dir, "documents"))
