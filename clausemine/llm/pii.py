"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a classifier decides.

Candidates are all matches of the base patterns (email, ip, card, phone), those that fail their check too, and looser
forms: written-out emails, cards and addresses with other separators, and phone numbers in one North American form.
On each candidate three kinds of labelers vote yes, no
or nothing: the regex (did the strict pattern and its check accept; no if the check failed), gazetteers (known domain endings,
card issuers, reserved address ranges, calling codes) and context (cue words between the match before and the span, what
touches it). The votes are counted over all candidates of all documents; expectation-maximisation on
that table (at most 3^5 vote patterns for each kind, whatever the corpus) estimates for each kind how reliable each
labeler is, and a logistic span classifier is trained on the posteriors. Base spans always stay; the
classifier decides about the rest.

Everything on the data is DataFrame functions. Positions come from the lengths of matches and of the
gaps between them, in code points. Patterns are anchored to the start of a run and possessive, and spans
are placed, compared and cut out in linear steps (see ``spans``), so very long texts and texts of very many spans
cost in proportion.

Defined results: null or empty text has no spans; repeated rows, null doc_ids and empty tables are
plain rows or none; other columns are ignored; a candidate that touches the same characters as a base span of
any kind is never added; equal spans of two kinds are both given.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize, table, texts
from .spans import PARTS, let, located, overlaps, piece, running

KINDS = ("email", "ip", "card", "phone")
LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){12,}+",  # shorter runs fail the check
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "ip": r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\x20?[\[(](?:\.|dot)[\])]\x20?[0-9]{1,3}){3}(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z.,+-])[0-9]{4}(?:[./_]|\x20[\x20-]\x20?)[0-9]{4}(?:[./_]|\x20[\x20-]\x20?)[0-9]{4}(?:[./_]|\x20[\x20-]\x20?)[0-9]{4}(?![0-9A-Za-z.,-])",
    "email": rf"(?<!{LOCAL})[A-Za-z0-9._%+-]++\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(](?:dot|DOT)[\])]\x20?)[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9A-Za-z.+-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z-])",
}
#: Gazetteers and cue words: fixed values.
DOMAIN_ENDS = r"(?i)[.\])]\s?(com|org|net|edu|gov|io|co|info|de|fr|es|uk|eu|us)$"
ISSUERS = r"^(4|5[1-5]|2[2-7]|3[47]|6011|65|35)"
RESERVED = r"^(0|10|127|169\.254|192\.168|22[4-9]|23[0-9]|24[0-9]|25[0-5])\."
CALLING = r"^\+?\(?(1|20|27|3[0-469]|4[0-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])"
CUES = {
    "email": r"(?i)\b(e-?mail|contact|write|mailto|correo|courriel)\W*\w{0,3}\W*$",
    "ip": r"(?i)\b(ip|host|server|address|client|from)\W*\w{0,3}\W*$",
    "card": r"(?i)\b(card|visa|mastercard|amex|credit|payment|tarjeta|carte|karte)\W*\w{0,6}\W*$",
    "phone": r"(?i)\b(phone|tel|telephone|call|mobile|cell|fax|telefon|contact)\W*\w{0,3}\W*$",
}
AGAINST = r"(?i)\b(version|v|isbn|issn|page|section|chapter|rev|release|build|order|sku|no)\W*$"
ROUNDS = 40
VOTERS = ("regex", "gazetteer", "cue", "counter_cue", "edges")


def luhn(digits: Column) -> Column:
    """Whether the check digit fits."""
    odd = F.length(digits) % 2
    value = lambda i: F.substring(digits, i, F.lit(1)).cast("int")
    doubled = lambda i: F.when(i % 2 == odd, value(i)).otherwise(value(i) * 2 - F.when(value(i) > 4, 9).otherwise(0))
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + doubled(i)) % 10 == 0


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def valid(kind: str, match: Column) -> Column:
    n = F.length(digits_of(match))
    if kind == "ip":
        bare = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(F.split(match, r"\."), lambda p: F.when(F.length(bare(p)) <= 3, F.concat(F.lit("0"), bare(p)).cast("int") <= 255).otherwise(False))
    if kind == "card":
        return n.between(13, 19) & F.when(n.between(13, 19), luhn(digits_of(match))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def votes(kind: str, regex: Column, span: Column) -> Column:
    """One digit per labeler, 0: no, 1: nothing, 2: yes."""
    left, after, match, digits = span["left"], span["after"], span["match"], digits_of(span["match"])
    gazetteer = {
        "email": F.when(match.rlike(DOMAIN_ENDS), 2).otherwise(1),
        "ip": F.when(match.rlike(RESERVED), 0).otherwise(2),
        "card": F.when(digits.rlike(ISSUERS), 2).otherwise(0),
        "phone": F.when(match.rlike(CALLING), 2).otherwise(1),
    }[kind]
    touched = left.rlike(r"[\p{L}0-9_=/]$") | after.rlike(r"^[\p{L}0-9_=/]")
    return F.concat(
        regex,
        gazetteer.cast("string"),
        F.when(left.rlike(CUES[kind]), "2").otherwise("1"),
        F.when(left.rlike(AGAINST), "0").otherwise("1"),
        F.when(touched, "0").otherwise("2"),
    )


def candidate(kind: str, strict: bool):
    """A match as ``struct<k, start, end, base, votes>``."""

    def made(s, base):
        regex = F.when(base, "2").otherwise("0") if strict else F.lit("1")
        return F.struct(F.lit(KINDS.index(kind)).alias("k"), s["start"].alias("start"), s["end"].alias("end"), base.alias("base"), votes(kind, regex, s).alias("votes"))

    return lambda s: made(s, F.lit(False)) if not strict else let(valid(kind, s["match"]), lambda ok: made(s, ok))


def candidates(text: Column) -> Column:
    """``array<struct<k int, start int, end int, base boolean, votes string>>`` of a text column without nulls: base spans, then others that touch none of them."""
    some_digit = text.rlike("[0-9]")
    hints = {("email", True): text.contains("@"), ("email", False): text.rlike(r"(?:at|AT)[\])]"), ("phone", True): text.contains("+"), ("ip", False): text.rlike(r"[\[(](?:\.|dot)[\])]"), ("card", False): text.rlike(r"[0-9]{4}[./_\x20-]{1,3}[0-9]{4}")}
    strict = {kind: F.transform(located(text, pattern, hints.get((kind, True), some_digit)), candidate(kind, True)) for kind, pattern in BASE.items()}
    loose = [F.transform(located(text, pattern, hints.get((kind, False), some_digit)), candidate(kind, False)) for kind, pattern in LOOSE.items()]

    def chosen(all_):
        base = F.struct(*(F.filter(all_[kind], lambda s: s["base"]).alias(kind) for kind in KINDS))
        others = F.concat(*(F.filter(all_[kind], lambda s: ~s["base"]) for kind in KINDS), all_["loose"])

        def free(b):
            def touches(s):
                found = F.lit(False)
                for kind in KINDS:
                    found = found | overlaps(b[kind], s)
                return found

            return F.concat(*(b[kind] for kind in KINDS), F.filter(others, lambda s: ~touches(s)))

        return let(base, free)

    return let(F.struct(*(strict[kind].alias(kind) for kind in KINDS), F.concat(*loose).alias("loose")), chosen)


def fit(spans: DataFrame, rounds: int = ROUNDS) -> dict[tuple[int, str], float]:
    """From ``k, votes`` rows to the classifier's probability of each (kind, votes) pattern.

    The table of patterns is bounded by the number of kinds and labelers, so it may come to the driver.
    """
    seen = [(r["k"], r["votes"], r["count"]) for r in spans.groupBy("k", "votes").count().collect()]
    posteriors = [row for kind in range(len(KINDS)) for row in reliabilities([s for s in seen if s[0] == kind], rounds)]
    return classifier(posteriors) if posteriors else {}


def reliabilities(seen: list[tuple[int, str, int]], rounds: int) -> list[tuple[int, str, int, float]]:
    """Expectation-maximisation over the vote patterns of one kind: each with its posterior of being true."""
    # the rates of each labeler's votes given a true or a false span; a labeler starts a little better than chance
    rate = {(j, v, y): 0.5 if (v == 2) == (y == 1) and v != 1 else 0.25 for j in range(len(VOTERS)) for v in range(3) for y in (0, 1)}
    prior, post = 0.7, {}
    for _ in range(rounds if seen else 0):
        for _, w, _ in seen:
            odds = math.log(prior / (1 - prior)) + sum(math.log(rate[j, int(v), 1] / rate[j, int(v), 0]) for j, v in enumerate(w))
            post[w] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        total = {y: sum(n * (post[w] if y else 1 - post[w]) for _, w, n in seen) for y in (0, 1)}
        prior = min(0.99, max(0.01, (total[1] + 1) / (total[0] + total[1] + 2)))
        for j in range(len(VOTERS)):
            for y in (0, 1):
                for v in range(3):
                    hit = sum(n * (post[w] if y else 1 - post[w]) for _, w, n in seen if int(w[j]) == v)
                    prefer = 2.0 if (v == 2) == (y == 1) and v != 1 else 1.0
                    rate[j, v, y] = (hit + prefer) / (total[y] + 4)
    return [(k, w, n, post[w]) for k, w, n in seen]


def features(k: int, w: str) -> list[float]:
    return [1.0, *(float(k == i) for i in range(len(KINDS))), *(float(int(v) - 1) for v in w)]


def classifier(rows: list[tuple[int, str, int, float]], steps: int = 400) -> dict[tuple[int, str], float]:
    """Logistic regression on the posteriors, weighted by how often a pattern occurs."""
    weight, total = [0.0] * (1 + len(KINDS) + len(VOTERS)), sum(n for _, _, n, _ in rows)
    say = lambda x: 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(weight, x, strict=True))))))
    for _ in range(steps):
        slope = [1e-3 * w for w in weight]
        for k, w, n, p in rows:
            x = features(k, w)
            miss = (say(x) - p) * n / total
            slope = [g + miss * a for g, a in zip(slope, x, strict=True)]
        weight = [a - 1.5 * g for a, g in zip(weight, slope, strict=True)]
    return {(k, w): say(features(k, w)) for k, w, _, _ in rows}


def decided(found: Column, model: dict[tuple[int, str], float], least: float = 0.5) -> Column:
    """Base spans and the loose ones that the classifier accepts."""
    accepted = [f"{k}{w}" for (k, w), p in sorted(model.items()) if p >= least]
    return F.filter(found, lambda s: s["base"] | F.concat(s["k"].cast("string"), s["votes"]).isin(accepted or [""]))


def written(spans: Column) -> Column:
    """kind:start:end, by kind as listed, then start."""
    name = F.array(*map(F.lit, KINDS))
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["k"].alias("k"), s["start"].alias("start"), s["end"].alias("end"))))
    return F.concat_ws(",", F.transform(keyed, lambda s: F.concat_ws(":", F.get(name, s["k"]), s["start"].cast("string"), s["end"].cast("string"))))


def with_candidates(docs: DataFrame, name: str) -> DataFrame:
    """Adds the candidates as a column, written, so that no later expression searches a text again."""
    return materialize(docs.withColumn(name, candidates(F.coalesce("text", F.lit("")))), "pii-candidates")


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added."""
    rows = materialize(texts(docs).select("doc_id", candidates(F.col("text")).alias("found")), "pii-candidates")
    model = fit(rows.select(F.explode("found").alias("s")).select("s.k", "s.votes"))
    rows = rows.withColumn("base", F.filter("found", lambda s: s["base"])).withColumn("all", decided(F.col("found"), model))
    count = lambda k: F.size(F.filter("base", lambda s: s["k"] == k)).cast("long")
    return rows.select(
        "doc_id",
        *(count(i).alias(f"n_{kind}") for i, kind in enumerate(KINDS)),
        F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        written(F.col("all")).alias("spans"),
        (F.size("all") - F.size("base")).cast("long").alias("n_added"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """The same rows and columns with every span's text replaced by its kind in angle brackets, and n_chars, if there is one, following."""
    found = "found"
    while found in docs.columns:
        found += "_"
    rows = with_candidates(docs, found)
    model = fit(rows.select(F.explode(found).alias("s")).select("s.k", "s.votes"))
    name = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))
    spans = F.array_sort(F.transform(decided(F.col(found), model), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["k"].alias("k"))))

    def cleaned(x):
        """What stands between the spans, with the name of a kind after each; a span that overlaps the ones before only has its rest removed."""
        size = F.char_length("text")

        def joined(ends):
            since = lambda i: F.coalesce(F.get(ends, i - 1), F.lit(0))
            kept = F.transform(x["spans"], lambda s, i: F.when(s["start"] >= since(i), F.concat(piece(x["parts"], since(i), s["start"] - since(i)), F.get(name, s["k"]))).otherwise(""))
            last = since(F.size(ends))
            return F.concat(F.array_join(kept, ""), piece(x["parts"], last, size - last))

        return let(F.transform(x["spans"], lambda s: s["end"]), lambda ends: let(running(ends, F.greatest), joined))

    clean = let(F.struct(spans.alias("spans"), F.regexp_extract_all("text", F.lit(PARTS), F.lit(0)).alias("parts")), cleaned)
    rows = rows.withColumn("text", F.when(F.size(found) > 0, clean).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long")))
    return rows.select(*docs.columns)


def op1_pii(spark, sf_dir):
    return personal_data(table(spark, sf_dir, "documents"))
