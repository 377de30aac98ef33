"""Personal data: base patterns, and boosted trees over high-recall candidates (JVM only).

The base patterns are matched and validated as the contract says; their spans stay. Looser
generators propose further spans, which may overlap those and each other. Gradient-boosted
trees score each proposal from its format and the words before it; they are fitted on a
bounded sample of proposals of every kind and label, labelled by what validation knows
(validated base spans and formats named by their context against what fails validation).
The proposals fall into two halves, and each is scored by trees fitted on the other, so all
scores are held-out ones. Per kind, the threshold is the lowest at which precision over all
proposals of the table holds; what scores above it and overlaps no base span is added.

Defined cases: null text is empty text; rows may repeat or lack a doc_id, each gets its
own result row; with too few proposals of either label nothing is added; an empty table
gives an empty result; further columns are ignored. Texts are scanned whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cladeflow.llm.keys import keyed
from cladeflow.llm.spans import SPAN, as_spans, count_kind, listed, no_spans, placed
from cladeflow.runtime import Scratch

BASE = ("email", "ip", "card", "phone")

# The base patterns of the contract. Runs are possessive and start where a run
# starts (or where the last match ended), which finds the same matches in linear time; runs of
# fewer digits than a card has fail whole, so they are not matched at all.
EMAIL = "(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++"
IP = "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++"
CARD = "[0-9](?:[\\x20-]?[0-9]){11,}+"
PHONE = "\\+[0-9][\\x20().0-9-]+[0-9]"

# Looser formats, and the words that go with them.
NUMBER = "(?<![0-9A-Za-z])[(+]?[0-9](?:[\\x20().-]{0,2}+[0-9]){6,18}+(?![0-9A-Za-z])"
HIDDEN_EMAIL = "(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\\x20?(?:\\[at\\]|\\(at\\))\\x20?[A-Za-z0-9-]{1,63}+\\x20?(?:\\[dot\\]|\\(dot\\)|\\.)\\x20?[A-Za-z]{2,24}"
CONTEXTS = {
    "c_phone": "(?i)\\b(tel|phone|mobile|cell|fax|call|whatsapp)\\b",
    "c_id": "(?i)\\b(ssn|social security|passport|national id|tax id)\\b",
    "c_card": "(?i)\\b(card|visa|mastercard|amex|account|iban)\\b",
}

#: Code points before a proposal that make its context; proposals the trees are fitted on, at most
#: about so many, and at least so many of either label; trees, their depth; precision to hold.
WINDOW, SAMPLE, LEAST, TREES, DEPTH, PRECISION = 32, 20_000, 20, 10, 3, 0.95
#: Hash values that draw the sample.
MARKS = 1_000_000_000
STEPS = [0.5, 0.6, 0.7, 0.8, 0.9, 0.95]


def digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Does a string of up to 19 digits pass the checksum?"""

    def weigh(acc: Column, i: Column) -> Column:
        d = F.substring(number, -i, 1).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(number), F.lit(1))), F.lit(0), weigh) % 10 == 0


def is_card(v: Column) -> Column:
    number = digits(v)
    n = F.length(number)
    return F.when((n >= 12) & (n <= 19), luhn(number)).otherwise(False)


def is_ip(v: Column) -> Column:
    def small(x: Column) -> Column:
        x = F.regexp_replace(x, "^0+(?=.)", "")
        return F.when(F.length(x) <= 3, x.cast("int") <= 255).otherwise(False)

    return F.forall(F.split(v, "\\."), small)


def is_phone(v: Column) -> Column:
    n = F.length(digits(v))
    return (n >= 9) & (n <= 15)


def find(rows: DataFrame) -> DataFrame:
    """``rid, doc_id, base, more`` of ``rid, doc_id, text``: base spans, and proposals with context."""
    patterns = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "number": NUMBER, "hidden": HIDDEN_EMAIL}
    step = rows.select("rid", "doc_id", "text", *[F.regexp_extract_all("text", F.lit(p), 0).alias(k) for k, p in patterns.items()])
    step = step.select("rid", "doc_id", "text", *[placed(F.col("text"), p, F.col(k)).alias(k) for k, p in patterns.items()])
    base = [
        as_spans(F.col("email"), "email", 0),
        as_spans(F.filter("ip", lambda x: is_ip(x["v"])), "ip", 1),
        as_spans(F.filter("card", lambda x: is_card(x["v"])), "card", 2),
        as_spans(F.filter("phone", lambda x: is_phone(x["v"])), "phone", 3),
    ]

    def proposal(kind: str):
        def one(x: Column) -> Column:
            before = F.substring(F.col("text"), F.greatest(x["s"] - WINDOW, F.lit(0)) + 1, F.least(x["s"], F.lit(WINDOW)))
            return F.struct(F.lit(kind).alias("gen"), x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v"), before.alias("before"))

        return one

    more = F.concat(F.transform("number", proposal("number")), F.transform("hidden", proposal("hidden")))
    return step.select("rid", "doc_id", F.array_sort(F.concat(*base)).alias("base"), more.alias("more"))


FEATURES = ["n_digits", "n_other", "n_chars", "plus", "paren", "checks", "f_334", "f_324", "f_date", "hidden", *CONTEXTS]


def proposals(found: DataFrame) -> DataFrame:
    """One row per proposal: its kind, features, weak label and whether it overlaps a base span."""
    x = found.select("rid", "base", F.explode("more").alias("x")).select("rid", "base", "x.*")
    flag = lambda c: c.cast("double")
    x = x.withColumn("number", digits(F.col("v")))
    x = x.select(
        "rid",
        "s",
        "e",
        F.exists("base", lambda b: (b["start"] < F.col("e")) & (b["end"] > F.col("s"))).alias("known"),
        F.length("number").cast("double").alias("n_digits"),
        (F.length("v") - F.length("number")).cast("double").alias("n_other"),
        F.length("v").cast("double").alias("n_chars"),
        flag(F.col("v").startswith("+")).alias("plus"),
        flag(F.col("v").contains("(")).alias("paren"),
        flag(F.when(F.length("number").between(12, 19), luhn(F.col("number"))).otherwise(False)).alias("checks"),
        flag(F.col("v").rlike("^\\(?[0-9]{3}\\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}$")).alias("f_334"),
        flag(F.col("v").rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$")).alias("f_324"),
        flag(F.col("v").rlike("^[0-9]{4}[.-][0-9]{1,2}[.-][0-9]{1,2}$|^[0-9]{1,2}[.-][0-9]{1,2}[.-][0-9]{4}$")).alias("f_date"),
        flag(F.col("gen") == "hidden").alias("hidden"),
        *[flag(F.col("before").rlike(p)).alias(k) for k, p in CONTEXTS.items()],
    )
    named = ((F.col("f_334") > 0) & (F.col("c_phone") > 0)) | ((F.col("f_324") > 0) & (F.col("c_id") > 0)) | (F.col("hidden") > 0)
    kind = F.when(F.col("hidden") > 0, "email_hidden").when(F.col("f_324") > 0, "national_id").when(F.col("checks") > 0, "card_loose").otherwise("phone_loose")
    return x.withColumn("label", (F.col("known") | named).cast("double")).withColumn("kind", kind)


KINDS = ["email_hidden", "national_id", "card_loose", "phone_loose"]


def select(cands: DataFrame, scratch: Scratch) -> DataFrame | None:
    """Proposals that the trees and calibrated thresholds accept; None if there is nothing to learn from."""
    counts = {(r.kind, r.label): r.n for r in cands.groupBy("kind", "label").agg(F.count("*").alias("n")).collect()}  # one row per kind and label
    if min(sum(n for (_, x), n in counts.items() if x == label) for label in (0.0, 1.0)) < LEAST:
        return None
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    mark = F.pmod(F.xxhash64("rid", "s", "e"), F.lit(MARKS))
    share = F.lit(0)
    for (kind, label), n in counts.items():
        share = F.when((F.col("kind") == kind) & (F.col("label") == label), min(MARKS, SAMPLE * MARKS // (2 * len(KINDS) * n) + 1)).otherwise(share)
    half = F.pmod(F.xxhash64("e", "s", "rid", F.lit("half")), F.lit(2))
    assembled = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(cands.withColumn("half", half))
    sample = assembled.where(mark < share).select("rid", "s", "e", "features", "label", "half")
    sample = scratch.put(sample.repartition(1).sortWithinPartitions("rid", "s", "e", "label"), "sample")
    score = vector_to_array("probability")[1]
    parts = []
    for k in (0, 1):
        fit = sample.where(F.col("half") == 1 - k)
        if fit.select("label").distinct().count() < 2:
            return None
        model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=16, seed=7).fit(fit)
        parts.append(model.transform(assembled.where(F.col("half") == k)).select("rid", "s", "e", "kind", "label", "known", score.alias("p")))
    scored = scratch.put(parts[0].unionByName(parts[1]), "scored")
    sums = [F.count_if((F.col("p") >= t) & (F.col("label") > 0)).alias(f"r{i}") for i, t in enumerate(STEPS)]
    sums += [F.count_if(F.col("p") >= t).alias(f"n{i}") for i, t in enumerate(STEPS)]
    limit = F.lit(2.0)  # kinds that never reach the precision add nothing
    for r in scored.groupBy("kind").agg(*sums).collect():  # one row per kind
        for i, t in enumerate(STEPS):
            if r[f"n{i}"] and r[f"r{i}"] >= PRECISION * r[f"n{i}"]:
                limit = F.when(F.col("kind") == r.kind, t).otherwise(limit)
                break
    return scored.where(~F.col("known") & (F.col("p") >= limit)).select("rid", "s", "e", "kind", "p")


def scan(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, base, spans`` (base spans, and all spans, sorted)."""
    found = scratch.put(find(keyed(docs, scratch, id_col, text_col)), "found")
    cands = scratch.put(proposals(found), "proposals")
    chosen = select(cands, scratch)
    if chosen is None:
        return found.select("doc_id", "base", F.col("base").alias("spans"))
    order = F.coalesce(*[F.when(F.col("kind") == k, F.lit(len(BASE) + i)) for i, k in enumerate(KINDS)])
    span = F.struct(F.col("s").alias("start"), order.alias("ord"), F.col("e").alias("end"), F.col("kind"))
    added = chosen.groupBy("rid").agg(F.collect_list(span).cast(SPAN).alias("added"))  # of one document
    out = found.join(added, "rid", "left")
    return out.select("doc_id", "base", F.array_sort(F.concat("base", F.coalesce("added", no_spans()))).alias("spans"))


def report(found: DataFrame) -> DataFrame:
    """Digest columns of the contract from ``doc_id, base, spans``."""
    return found.select(
        "doc_id",
        *[count_kind(F.col("base"), k).alias(f"n_{k}") for k in BASE],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )
