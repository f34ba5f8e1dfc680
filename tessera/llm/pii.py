"""Personal data by scored candidates.

High-recall generators propose overlapping spans; gradient-boosted trees score each by
its format and context; for every kind a calibrated threshold selects those that are
added.  The strict base patterns are always reported, and teach the trees: positive
examples are base spans of the corpus rewritten into forms that only the generators accept
(spelt-out signs, other separators, a missing plus), in the contexts of the originals.
Negative examples are the candidates of the corpus that touch no base span and have something
against them (a failing check, or no word of their kind before them), and base spans turned
into look-alikes (prices after a sign, numbers past 255, a wrong check digit, plain digit
runs).  Candidates with nothing against them have no label: they are scored only.

Candidates, features, labels, training and scoring are DataFrame operations.

Defined results: a null text is an empty one without spans; rows with a null or repeated
id are searched row by row; without examples of both labels nothing is learned and the
base spans are the result, and a kind whose scores never reach the wanted precision adds
nothing; a candidate that overlaps a base span is not added; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.spans import count_of, digits, find, luhn, of_kind, ordered, written
from tessera.llm.textops import stored

KINDS = ("email", "ip", "card", "phone")
#: The base patterns (with possessive repetition).
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[ -]?[0-9]){11,}+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: The generators: the same kinds with loose separators and without leading signs.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:@|\[at\]|\(at\)) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|\[dot\]|\(dot\)) ?[A-Za-z0-9-]{1,63}+){1,8}+",
    "ip": r"(?<![0-9])[0-9]{1,3}+(?:[._ -][0-9]{1,3}+){3}",
    "card": r"[0-9](?:[ .-]{0,2}[0-9]){10,22}+",
    "phone": r"(?:\+|\()?+[0-9](?:[ ().-]{0,2}[0-9]){6,16}+",
}
#: Words of the context that speak for each kind.
HINTS = {
    "email": "(?i)mail|contact|write",
    "ip": "(?i)host|server|addr|login",
    "card": "(?i)card|visa|account|pay|credit",
    "phone": "(?i)tel|phone|call|fax|mobil",
}
#: Code points of context on each side.
CONTEXT = 24
#: Trees, depth, and the calibrated precision asked of added spans.
TREES, DEPTH, PRECISION = 12, 3, 0.98
#: Steps that scores are calibrated in.
STEPS = 50

FEATURES = (
    "n_chars", "n_digits", "n_letters", "n_separators", "n_groups", "distinct_digits", "luhn_ok", "largest_group",
    "largest_number", "plus", "paren", "at_sign", "dots", "word_before", "word_after", "hint", "digit_near", "kind_no",
)


def _ip_ok(span: Column) -> Column:
    part = lambda p: F.ltrim(p, F.lit("0"))
    return F.forall(F.split(span["value"], r"\."), lambda p: (F.length(part(p)) < 3) | ((F.length(part(p)) == 3) & (part(p) <= "255")))


def _card_ok(span: Column) -> Column:
    number = digits(span["value"])
    return F.when(F.length(number).between(12, 19), luhn(number)).otherwise(False)


def base_spans(text: Column) -> Column:
    email = find(text, EMAIL, text.contains("@"))
    ip = F.filter(find(text, IP, text.rlike(r"[0-9]\.[0-9]")), _ip_ok)
    card = F.filter(find(text, CARD, text.rlike("[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]")), _card_ok)
    phone = F.filter(find(text, PHONE, text.contains("+")), lambda s: F.length(digits(s["value"])).between(9, 15))
    return ordered(*(of_kind(s, k, i) for i, (k, s) in enumerate(zip(KINDS, (email, ip, card, phone), strict=True))))


def loose_spans(text: Column) -> Column:
    likely = {
        "email": text.rlike(r"@|\[at\]|\(at\)"),
        "ip": text.rlike(r"[0-9][._ -][0-9]"),
        "card": text.rlike(r"[0-9][ .-]{0,2}[0-9][ .-]{0,2}[0-9]"),
        "phone": text.rlike(r"[0-9][ ().-]{0,2}[0-9][ ().-]{0,2}[0-9]"),
    }
    return ordered(*(of_kind(find(text, LOOSE[k], likely[k]), k, i) for i, k in enumerate(KINDS)))


def _with_context(text: Column, spans: Column) -> Column:
    def one(s: Column) -> Column:
        left = F.greatest(F.lit(0), s["start"] - CONTEXT)
        return F.struct(
            *[s[n].alias(n) for n in ("start", "rank", "end", "kind", "value")],
            F.substring(text, left + 1, s["start"] - left).alias("left"),
            F.substring(text, s["end"] + 1, F.lit(CONTEXT)).alias("right"),
        )

    return F.transform(spans, one)


def _rows(docs: DataFrame) -> DataFrame:
    """Base spans and candidates of every row, stored with a number for the row."""
    text = F.col("text")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = rows.select("doc_id", _with_context(text, base_spans(text)).alias("base"), _with_context(text, loose_spans(text)).alias("loose"))
    return stored(found.withColumn("row", F.monotonically_increasing_id()), "personal")


def candidates(rows: DataFrame) -> DataFrame:
    """One row for each candidate with its features.

    ``label`` says whether a base span of its kind has its place, ``apart`` that it
    overlaps no base span at all.
    """
    one = rows.where(F.size("loose") > 0).select("doc_id", "row", "base", F.explode("loose").alias("c"))
    strict = F.exists(
        "base", lambda b: (b["kind"] == F.col("c.kind")) & (b["start"] == F.col("c.start")) & (b["end"] == F.col("c.end"))
    )
    apart = ~F.exists("base", lambda b: (b["start"] < F.col("c.end")) & (b["end"] > F.col("c.start")))
    flat = one.select("doc_id", "row", "c.*", strict.cast("double").alias("label"), apart.alias("apart"))
    return _featured(flat, "doc_id", "row", "start", "rank", "end", "kind", "value", "left", "right", "label", "apart")


def _variants(kind: str, value: Column) -> list[Column]:
    """A base span in forms that only the generator of its kind accepts."""
    name, host = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    number = digits(value)
    grouped = lambda by: F.regexp_replace(number, "([0-9]{4})(?=[0-9])", "$1" + by)
    bare = F.ltrim(F.substring(value, 2, F.length(value)))
    return {
        "email": [
            F.concat(name, F.lit("[at]"), host),
            F.concat(name, F.lit(" (at) "), host),
            F.concat(name, F.lit(" [at] "), F.replace(host, F.lit("."), F.lit(" [dot] "))),
            F.concat(name, F.lit("(at)"), F.replace(host, F.lit("."), F.lit("(dot)"))),
        ],
        "ip": [F.replace(value, F.lit("."), F.lit(by)) for by in ("-", "_", " ")],
        "card": [grouped("."), grouped("  "), grouped(" - ")],
        "phone": [bare, F.regexp_replace(bare, "[ ()-]+", "."), F.concat(F.lit("("), F.substring(number, 1, 2), F.lit(") "), F.substring(number, 3, 20))],
    }[kind]


def _look_alikes(kind: str, value: Column) -> list[Column]:
    """A base span made into something else that the generator of its kind accepts."""
    number = digits(value)
    some = F.pmod(F.xxhash64(value), F.lit(900))
    price = F.concat((some % 90 + 1).cast("string"), F.lit("."), (some % 89 + 10).cast("string"))
    wrong = F.concat(F.substring(number, 1, 11), F.substring(number, 12, 8).cast("bigint") + 1)
    return {
        "email": [F.concat(word, price) for word in map(F.lit, ("sold (at) ", "offer @ ", "rate [at] "))],
        "ip": [F.concat((some + 256).cast("string"), F.lit(by), F.substring_index(value, ".", -3)) for by in (".", "-", " ")],
        "card": [wrong, F.regexp_replace(wrong, "([0-9]{4})(?=[0-9])", "$1 "), F.regexp_replace(wrong, "([0-9]{4})(?=[0-9])", "$1.")],
        "phone": [number, F.regexp_replace(F.concat(F.lit("20"), F.substring(number, 1, 6)), "([0-9]{4})([0-9]{2})([0-9]{2})", "$1-$2-$3")],
    }[kind]


def _matching(values: Column, pattern: str) -> Column:
    return F.filter(values, lambda v: v.rlike(pattern))


def examples(rows: DataFrame, found: DataFrame) -> DataFrame:
    """What the trees learn from, with features: rewritten base spans, look-alikes, candidates apart."""
    one = rows.where(F.size("base") > 0).select("doc_id", F.explode("base").alias("b"))
    flat = one.select("doc_id", *[f"b.{n}" for n in ("kind", "rank", "value", "left", "right")])

    def made(of, label: float) -> DataFrame:
        forms = F.array().cast("array<string>")
        for kind in KINDS:
            accepted = _matching(F.array(*of(kind, F.col("value"))), rf"^(?:{LOOSE[kind]})$")
            forms = F.when(F.col("kind") == kind, accepted).otherwise(forms)
        return flat.withColumn("value", F.explode(forms)).withColumn("label", F.lit(label))

    names = ("doc_id", "kind", "rank", "value", "left", "right", "label")
    taught = _featured(made(_variants, 1.0).unionByName(made(_look_alikes, 0.0)), *names)
    return taught.unionByName(found.where(F.col("apart") & _refuted()).select(*names, *FEATURES))


def _refuted() -> Column:
    """Whether something speaks against a candidate: a check of its kind, or no hint before it."""
    no_hint, n = F.col("hint") == 0, F.col("n_digits")
    against = {
        "email": ~F.col("value").rlike("[A-Za-z]{2,}$"),
        "ip": no_hint | (F.col("largest_number") > 255),
        "card": no_hint | (F.col("luhn_ok") == 0) | ~n.between(12, 19),
        "phone": no_hint | ~n.between(9, 15),
    }
    found = F.lit(False)
    for kind, test in against.items():
        found = F.when(F.col("kind") == kind, test).otherwise(found)
    return found


def _featured(flat: DataFrame, *names: str) -> DataFrame:
    """``names`` of the spans, and features of their kind, value, left and right context."""
    value, left, right = F.col("value"), F.col("left"), F.col("right")
    number = digits(value)
    groups = F.filter(F.split(value, "[^0-9]+"), lambda g: g != "")
    hint = F.lit(False)
    for kind in KINDS:
        hint = F.when(F.col("kind") == kind, left.rlike(HINTS[kind])).otherwise(hint)
    size = lambda c: F.length(c).cast("double")
    flag = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    features = {
        "n_chars": size(value),
        "n_digits": size(number),
        "n_letters": size(F.regexp_replace(value, "[^A-Za-z]", "")),
        "n_separators": size(F.regexp_replace(value, "[A-Za-z0-9]", "")),
        "n_groups": F.size(groups).cast("double"),
        "distinct_digits": F.size(F.array_distinct(F.transform(F.sequence(F.lit(1), F.least(F.length(number) + 1, F.lit(40))), lambda i: F.substring(number, i, F.lit(1))))).cast("double"),
        "luhn_ok": flag(F.when(F.length(number).between(8, 40), luhn(number))),
        "largest_group": F.coalesce(F.array_max(F.transform(groups, lambda g: F.length(g))), F.lit(0)).cast("double"),
        "largest_number": F.coalesce(F.array_max(F.transform(groups, lambda g: F.substring(g, 1, 9).cast("double"))), F.lit(0.0)),
        "plus": flag(value.startswith("+")),
        "paren": flag(value.contains("(")),
        "at_sign": flag(value.contains("@")),
        "dots": size(F.regexp_replace(value, r"[^.]", "")),
        "word_before": flag(left.rlike("[A-Za-z0-9_.-]$")),
        "word_after": flag(right.rlike("^[A-Za-z0-9_-]")),
        "hint": flag(hint),
        "digit_near": flag(left.rlike("[0-9] ?$") | right.rlike("^ ?[0-9]")),
        "kind_no": F.col("rank").cast("double"),
    }
    return flat.select(*names, *[features[f].alias(f) for f in FEATURES])


def _vectors(found: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(found)


def _distinct(found: DataFrame) -> DataFrame:
    """All distinct examples; ``back`` marks a third of the documents.

    Of an example that several documents hold, the least id decides.
    """
    one = found.groupBy("kind", "label", "value", "left", "right", *FEATURES).agg(F.min("doc_id").alias("doc_id"))
    return stored(one.withColumn("back", F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0), "examples")


def _least_step(steps: list[tuple[int, int, float]]) -> int | None:
    """Isotonic calibration: the least step from which on the precision, made to rise with the score, is wanted.

    ``steps`` are (step, examples, positives), at most :data:`STEPS` + 1.
    """
    pools: list[list[float]] = []  # first step, examples, positives
    for step, n, good in sorted(steps):
        pools.append([step, n, good])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            _, n, good = pools.pop()
            pools[-1][1] += n
            pools[-1][2] += good
    return next((int(first) for first, n, good in pools if good >= PRECISION * n), None)


def learn(found: DataFrame) -> tuple[GBTClassificationModel | None, dict[str, float]]:
    """Trees and the score threshold of each kind.

    Learns from all distinct examples; two thirds of the documents grow the trees and one
    third calibrates the scores of each kind.
    """
    taught = _distinct(found)
    labels = {r["label"] for r in taught.where("not back").select("label").distinct().collect()}
    if labels != {0.0, 1.0}:
        return None, {}
    grow = _vectors(taught.where("not back")).select("label", "features")
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=5).fit(grow)
    held = _scored(taught.where("back"), model)
    steps = held.withColumn("step", F.floor(F.col("score") * STEPS)).groupBy("kind", "step").agg(F.count("*").alias("n"), F.sum("label").alias("good"))
    of_kind_: dict[str, list[tuple[int, int, float]]] = {}
    for row in steps.collect():  # at most 51 steps of a kind
        of_kind_.setdefault(row["kind"], []).append((row["step"], row["n"], row["good"]))
    limits = {kind: _least_step(rows) for kind, rows in of_kind_.items()}
    return model, {kind: step / STEPS for kind, step in limits.items() if step is not None}


def _scored(found: DataFrame, model: GBTClassificationModel) -> DataFrame:
    scored = model.transform(_vectors(found))
    return scored.withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, base spans, and all spans (base ones and selected candidates with their score).

    Texts are read once and not shuffled.  Rows of candidates are narrow; those selected
    are gathered by row.
    """
    rows = _rows(docs)
    found = candidates(rows)
    model, limits = learn(examples(rows, found))
    names = ("start", "rank", "end", "kind", "value")
    sure = lambda s: F.struct(*[s[n].alias(n) for n in names], F.lit(1.0).alias("score"))
    base = F.transform("base", sure)
    if model is None or not limits:
        return rows.select("doc_id", "base", base.alias("spans"))
    limit = F.lit(2.0)
    for kind, least in limits.items():
        limit = F.when(F.col("kind") == kind, F.lit(least)).otherwise(limit)
    chosen = _scored(found.where("apart"), model).where(F.col("score") >= limit)
    grouped = chosen.groupBy("row").agg(F.collect_list(F.struct(*names, "score")).alias("added"))
    some = F.size("loose") > 0
    none = rows.where(~some).select("doc_id", "base", base.alias("spans"))
    nothing = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,value:string,score:double>>")
    full = rows.where(some).join(grouped, "row", "left")
    return none.unionByName(full.select("doc_id", "base", ordered(base, F.coalesce("added", nothing)).alias("spans")))


def redacted(text: Column, spans: Column) -> Column:
    """A text with its spans replaced by their kind; of overlapping spans the first counts."""

    def step(state: Column, s: Column) -> Column:
        kept = F.concat(state["done"], F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.when(s["start"] >= state["at"], F.struct(kept.alias("done"), s["end"].alias("at"))).otherwise(state)

    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))
    return F.aggregate(spans, start, step, lambda s: F.concat(s["done"], F.substring(text, s["at"] + 1, F.length(text))))


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of the base spans, and all spans written out."""
    return found.select(
        "doc_id",
        *[count_of(F.col("base"), k).alias(f"n_{k}") for k in KINDS],
        F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )
