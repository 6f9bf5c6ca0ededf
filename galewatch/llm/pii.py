"""Personal data: high-recall generators, gradient-boosted trees on format and context, calibrated thresholds.

1. Generators propose spans of four kinds, which may overlap. Base spans that pass their kind's validator (octets,
   Luhn, digit counts) are certain and kept. Base spans that fail it, and spans of looser formats, are open.
2. The trees see format and context only, never the validator's outcome. They are fitted on labelled spans of two
   sources: examples, texts made up here by rule (the same SEEDS on every input), in which each kind stands in sentences
   where it is personal and in others where it is a decoy (order and part numbers, versions, dates, identifiers); and
   every base span of the corpus, labelled by its validator. Spans alike in all features, label and part of the fit are
   one row with their number, which loses nothing: the trees see no more of a span. So that the examples, the only decoys
   of e-mails, are heard on a corpus of any size, the corpus spans of a kind and outcome weigh at most CORPUS_WEIGHT
   together, each the same. Spark takes all rows for its split candidates (see `_trees`).
3. Thresholds rest on every labelled span as well. Both sources are dealt to FOLDS parts: of the examples whole templates
   (a format and the sentence it stands in), of the corpus whole texts. Each part is scored by trees fitted on the
   others, so that no row is scored by trees that saw a sibling of it; the trees that are used are then fitted on all. A
   kind's threshold is the lowest score from which the share of personal spans reaches PRECISION among the examples, and
   also in the corpus, where the examples' precision counts as PRIOR rows of each part. Between two scores that occur it lies in their
   middle. `calibration` tells thresholds, rows, precision and recall, and the recall of loose formats that are planted
   into texts of the corpus.
4. An open span is added where its score reaches its kind's threshold, unless a base span covers it.

Everything on the executors is DataFrame functions and Spark's own boosted trees (no Python there).

Defined cases: a null text is empty and has no spans; repeated rows each get the spans of their text; a null doc_id is
kept; an empty table gives an empty result; the context of a span ends at the neighbouring spans of its generator.
"""

from __future__ import annotations

from functools import reduce
from math import isqrt
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galewatch.functions.bind import held
from galewatch.llm.common import joined_spans, stored, table, text_of, with_spans

KINDS = ("email", "ip", "card", "phone")

#: The same matches as the plain patterns; possessive repeats and look-behind only keep long runs linear.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser formats, for open spans only: letters of any script and spelt-out signs in addresses, addresses made
#: unclickable or of eight groups, cards with dots, national numbers and strict international ones.
LOOSE = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++|(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]++(?:(?:\x20?[\[(](?:dot|DOT)[\])]\x20?|\.)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z.\]])[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3}(?![0-9\[])|(?<![0-9A-Za-z:])[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4}){7}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9.+-])[0-9]{4}[.][0-9]{4}[.][0-9]{4}[.][0-9]{4}(?![0-9.-])",
    "phone": r"(?<![0-9.(+-])(?:\+[0-9]{1,3}[\x20.-])?(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
}
#: Words before a span that speak for its kind, and words that speak for a decoy.
CUES = {
    "email": r"(?i)(mail|contact|write|reach|reply|address|send)", "ip": r"(?i)(\bip\b|server|host|address|login|client|from|gateway)",
    "card": r"(?i)(card|visa|mastercard|credit|debit|account|pay)", "phone": r"(?i)(tel|phone|call|fax|mobile|cell|ring|dial|whatsapp)",
}
DECOYS = r"(?i)(order|invoice|version|release|build|part|serial|isbn|\bid\b|ref|ticket|tracking|page|section|date|model|article|handle|package|score)"
FEATURES = 13
#: Examples for each kind and outcome; what the corpus spans of a kind and outcome weigh together in a fit, at most, where
#: an example weighs 1; parts that are scored by trees fitted on the others; precision asked of added spans.
SEEDS, CORPUS_WEIGHT, FOLDS, PRECISION, PRIOR = 400, 1000, 3, 0.95, 20
#: Rows of different spans that one task fits; up to these, sums have one order and the trees are the same on every run.
FIT_ROWS = 200_000
#: Bins of scores that thresholds are set by; texts of the corpus for each kind that `calibration` plants a span into.
BINS, PLANTED = 50, 100

#: What the examples' spans stand in: sentences before them by kind and for decoys, and words around them.
BEFORE = {
    "email": ("mail me at ", "contact: ", "write to ", "please reply to ", "you can reach us under ", ""), "ip": ("the server is ", "login from ", "ip: ", "host ", "client address ", ""),
    "card": ("my card number is ", "visa ", "credit card: ", "charge account ", "pay with ", "the debit card "), "phone": ("call ", "phone: ", "tel. ", "mobile ", "fax ", ""),
}
DECOYS_BEFORE = ("order ", "invoice no. ", "version ", "release ", "part number ", "serial ", "isbn ", "id=", "ref: ", "ticket ", "tracking ", "see section ", "date ", "package ", "score ")
FILLER = ("the report was sent and ", "as we said, ", "for the rest ", "on monday ", "it was late; ", "after that ")


def luhn(digits: Column) -> Column:
    """Whether a digit string passes Luhn's check."""
    n = F.length(digits)
    step = lambda i: (F.substring(digits, n - i, 1).cast("int") * F.when(i % 2 == 1, 2).otherwise(1))
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + step(i) - F.when(step(i) > 9, 9).otherwise(0)) % 10 == 0


def valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")).between(0, 3) & (F.coalesce(F.substring(F.regexp_replace(p, "^0+", ""), 1, 3).try_cast("int"), F.lit(0)) <= 255))
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def features(spans: DataFrame) -> list[Column]:
    """Columns f0, f1, ... of spans (kind, rank, hit, before, after). Format: lengths, digits, letters, separators, groups,
    first digit, letters beyond ASCII, sign. Context: cue for the kind, cue for a decoy, what stands directly before and
    after."""
    told = lambda c: F.when(c, 1).otherwise(0)
    hit, before, after = (spans[c] for c in ("hit", "before", "after"))
    digits = F.regexp_replace(hit, "[^0-9]", "")
    cue = F.coalesce(*[F.when(spans["kind"] == k, before.rlike(CUES[k])) for k in KINDS])
    return [x.cast("double").alias(f"f{i}") for i, x in enumerate((
        F.length(hit), F.length(digits), F.length(F.regexp_replace(hit, "[^A-Za-z]", "")), F.length(F.regexp_replace(hit, r"[^\x20().-]", "")), F.size(F.split(hit, "[^0-9]+")),
        F.coalesce(F.substring(digits, 1, 1).try_cast("int"), F.lit(-1)), F.length(F.regexp_replace(hit, r"[\x00-\x7F]", "")), told(F.substring(hit, 1, 1) == "+"),
        told(cue), told(before.rlike(DECOYS)), told((before == "") | before.rlike(r"[\s:;,(\"'<>]$")), told((after == "") | after.rlike(r"^[\s:;,.!?)\"'<>]")), spans["rank"],
    ))]


def proposals(docs: DataFrame) -> DataFrame:
    """doc_id, text -> doc_id, text_hash, base array<start, rank, kind, end>, found array<... valid, loose, hit, before, after>."""
    rows = docs.select("doc_id", text_of().alias("_text"))
    rows = with_spans(rows, "_text", {f"_{k}": p for k, p in BASE.items()} | {f"_loose_{k}": p for k, p in LOOSE.items()})

    def told(kind: str, s: Column, sure: Column, loose: bool) -> Column:
        return F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end"), sure.alias("valid"), F.lit(loose).alias("loose"), *[s[c].alias(c) for c in ("hit", "before", "after")])

    def proposed(kind: str, loose: bool = False) -> Column:
        spans = F.col(f"_loose_{kind}" if loose else f"_{kind}")
        if kind == "card" and not loose:  # a digit run is proposed as a card only in a card's length
            spans = F.filter(spans, lambda s: F.length(F.regexp_replace(s["hit"], "[^0-9]", "")).between(12, 19))
        return F.transform(spans, lambda s: told(kind, s, F.lit(False) if loose else valid(kind, s["hit"]), loose))

    found = [proposed(k) for k in KINDS] + [proposed(k, loose=True) for k in LOOSE]
    rows = rows.select("doc_id", F.xxhash64("_text").alias("text_hash"), F.concat(*found).alias("found"))
    plain = lambda xs: F.transform(xs, lambda s: F.struct(s["start"], s["rank"], s["kind"], s["end"]))
    return rows.select("doc_id", "text_hash", plain(F.filter("found", lambda s: s["valid"])).alias("base"), "found")


def examples(spark: SparkSession) -> DataFrame:
    """doc_id, text, kind, label, template, before, hit: SEEDS made-up texts for each kind and outcome, the same on every run."""
    draw = lambda k, n: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(n)).cast("int")
    pick = lambda k, xs: F.element_at(F.array(*[F.lit(x) for x in xs]), draw(k, len(xs)) + 1)
    digits = lambda k, n: F.lpad(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(10**n)).cast("string"), n, "0")
    number = lambda k, n: draw(k, n).cast("string")
    between = lambda sep, xs: F.concat(xs[0], *[y for x in xs[1:] for y in (sep, x)])
    name = F.concat(pick(20, ("anna", "b.weiss", "jörg", "info", "müller.k", "x_y")), digits(21, 2))
    host = F.concat(pick(22, ("mail", "post", "example", "büro")), digits(23, 1), F.lit("."), pick(24, ("com", "org", "example.net", "de")))
    good = {
        "email": F.when(draw(1, 2) == 0, F.concat(name, F.lit("@"), host)).otherwise(F.concat(F.translate(name, "öü", "ou"), pick(2, (" (at) ", "[at]", " [AT] ")), F.lit("post"), pick(3, (" (dot) ", "[dot]", ".")), F.lit("org"))),
        "ip": F.when(draw(1, 3) == 0, F.array_join(F.array(*[F.hex(draw(k, 65536)) for k in range(30, 38)]), ":")).otherwise(between(pick(2, (".", "[.]")), [number(k, 256) for k in range(30, 34)])),
        "card": between(pick(2, ("", " ", "-", ".")), [F.concat(pick(3, "3456"), digits(4, 3)), digits(5, 4), digits(6, 4), digits(7, 4)]),
        "phone": F.concat(pick(1, ("+1 ", "+44 ", "")), F.when(draw(2, 2) == 0, F.concat(F.lit("("), digits(3, 3), F.lit(") "))).otherwise(F.concat(digits(3, 3), F.lit("-"))), digits(4, 3), pick(5, ("-", " ")), digits(6, 4)),
    }
    bad = {
        "email": F.concat(F.when(draw(1, 2) == 0, F.concat(digits(2, 6), F.lit("@"), digits(3, 1), F.lit("."), digits(4, 2))).otherwise(F.concat(name, F.lit("@"), digits(5, 1), F.lit("."), digits(6, 1), F.lit("."), digits(7, 2)))),
        "ip": between(pick(2, (".", "[.]")), [number(k, n) for k, n in ((30, 20), (31, 40), (32, 1200), (33, 3000))]),
        "card": good["card"], "phone": F.concat(pick(1, ("", "", "+1 ")), digits(3, 3), pick(4, ("-", " ", ".")), digits(5, 3), pick(6, ("-", " ", ".")), digits(7, 4)),
    }
    rows = spark.range(0, 2 * len(KINDS) * SEEDS, 1, 1)
    number_of, label = F.floor(F.col("id") / (2 * SEEDS)), F.floor(F.col("id") / SEEDS) % 2 == 0
    choose = lambda values: F.element_at(F.array(*[values[k] for k in KINDS]), (number_of + 1).cast("int"))
    hit = F.when(label, choose(good)).otherwise(choose(bad))
    before = F.when(label, choose({k: pick(41, BEFORE[k]) for k in KINDS})).otherwise(pick(41, DECOYS_BEFORE))
    text = F.concat(pick(40, FILLER), before, hit, pick(42, (" ", ".", ", ")), pick(43, FILLER))
    # A template: the sentence before, and the hit with its letters and digits left out.
    template = F.xxhash64(number_of, label, before, F.regexp_replace(hit, r"[\p{L}\p{N}]+", "x"))
    return rows.select(F.col("id").alias("doc_id"), text.alias("text"), choose({k: F.lit(k) for k in KINDS}).alias("kind"), label.cast("int").cast("double").alias("label"), template.alias("template"), before.alias("before"), hit.alias("hit"))


def lowest(rows: list) -> float | None:
    """The lowest score from which precision holds, by bins of a kind's scores; None where it never does."""
    bins = sorted({r["bin"] for r in rows}, reverse=True)
    n, good, found = {"examples": 0.0, "corpus": 0.0}, {"examples": 0.0, "corpus": 0.0}, None
    for b, below in zip(bins, [*bins[1:], -1]):
        for r in rows:
            if r["bin"] == b:
                n[r["part"]] += r["n"]
                good[r["part"]] += r["good"]
        made = good["examples"] / n["examples"] if n["examples"] else 0.0
        if made >= PRECISION and good["corpus"] + FOLDS * PRIOR * made >= PRECISION * (n["corpus"] + FOLDS * PRIOR):
            found = (b + below + 1) / 2 / BINS
    return found


def _vectors(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=[f"f{i}" for i in range(FEATURES)], outputCol="vector").transform(rows)


def _scored(model: GBTClassificationModel, rows: DataFrame) -> DataFrame:
    return model.transform(_vectors(rows)).withColumn("score", F.get(vector_to_array("probability"), F.lit(1)))


def _trees(rows: DataFrame, n: int) -> GBTClassificationModel:
    """Trees fitted on rows (label, weight, features), at most n. Beyond maxBins squared (and 10,000) rows Spark draws a
    sample for its split candidates; there are always enough bins to take them all."""
    return GBTClassifier(featuresCol="vector", labelCol="label", weightCol="weight", maxIter=8, maxDepth=3, maxBins=max(32, isqrt(n) + 1), seed=1, cacheNodeIds=False).fit(_vectors(rows))


def labelled(rows: DataFrame) -> DataFrame:
    """proposals of a corpus -> kind, label, part, group, f0, f1, ...: every base span of the corpus and of the examples."""
    spans = rows.select("text_hash", F.explode(F.filter("found", lambda s: ~s["loose"])).alias("s")).select("text_hash", "s.*")
    sure = spans.select("kind", "rank", F.col("valid").cast("double").alias("label"), F.lit("corpus").alias("part"), F.xxhash64("text_hash").alias("group"), "hit", "before", "after")
    made = stored(examples(rows.sparkSession), "pii_examples")
    told = proposals(made.select("doc_id", "text")).select("doc_id", F.explode("found").alias("s")).select("doc_id", "s.*").join(made.select("doc_id", F.col("kind").alias("_kind"), "label", "template"), "doc_id").where(F.col("kind") == F.col("_kind"))
    told = told.select("kind", "rank", "label", F.lit("examples").alias("part"), F.col("template").alias("group"), "hit", "before", "after")
    every = sure.unionByName(told)
    return every.select("kind", "label", "part", "group", *features(every))


def fitted(rows: DataFrame) -> tuple[GBTClassificationModel, dict[str, float], list[tuple]]:
    """proposals of a corpus (stored) -> the model, thresholds by kind, and the rows of `calibration`.

    A kind without a threshold that reaches PRECISION has none, and nothing is added for it.
    """
    keys = ["part", "kind", "label", "fold", *[f"f{i}" for i in range(FEATURES)]]
    every = stored(labelled(rows), "pii_labelled").withColumn("fold", F.pmod("group", F.lit(FOLDS)).cast("int"))  # whole templates and whole texts
    alike = stored(every.groupBy(*keys).agg(F.count("*").alias("n")), "pii_alike")
    there = alike.groupBy("part", "kind", "label").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).collect()
    weigh = {f"{r['part']}{r['kind']}{r['label']}": min(1.0, CORPUS_WEIGHT / r["n"]) for r in there if r["part"] == "corpus"}
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in (weigh | {"": 1.0}).items() for x in kv]), F.concat("part", "kind", F.col("label").cast("string"))), F.lit(1.0))
    n = sum(r["rows"] for r in there)
    alike = stored(alike.withColumn("weight", F.col("n") * weight).repartition(1 + n // FIT_ROWS).sortWithinPartitions(*keys), "pii_weighed")
    # The fits are many short jobs on few rows, so they run side by side: one for each part on the others, one on all.
    fit = inheritable_thread_target(rows.sparkSession)(lambda k: _trees(alike.where(F.col("fold") != k), n))
    with ThreadPool(FOLDS + 1) as pool:
        *others, model = pool.map(fit, range(FOLDS + 1))
    folds = [_scored(m, alike.where(F.col("fold") == k)).select("kind", "part", "label", "n", F.floor(F.col("score") * BINS).alias("bin")) for k, m in enumerate(others)]
    bins = reduce(DataFrame.unionByName, folds).groupBy("kind", "part", "bin").agg(F.sum("n").alias("n"), F.sum(F.col("label") * F.col("n")).alias("good")).collect()
    limits, report = {}, []
    for kind in KINDS:
        own = [b for b in bins if b["kind"] == kind]
        limit = lowest(own)
        if limit is not None:
            limits[kind] = limit
        for part in ("examples", "corpus"):
            all_ = [b for b in own if b["part"] == part]
            above = [b for b in all_ if limit is not None and b["bin"] / BINS >= limit]
            taken, good, every_good = sum(b["n"] for b in above), sum(b["good"] for b in above), sum(b["good"] for b in all_)
            report.append((kind, part, limit, sum(b["n"] for b in all_), good / taken if taken else None, good / every_good if every_good else None))
    return model, limits, report


def added(rows: DataFrame, model: GBTClassificationModel, limits: dict[str, float]) -> DataFrame:
    """proposals -> doc_id, text_hash, more: the open spans that reach their kind's threshold and no base span covers."""
    uncovered = lambda s: ~s["valid"] & ~F.exists("base", lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"]))
    open_ = rows.select("doc_id", "text_hash", F.explode(F.filter("found", uncovered)).alias("s")).select("doc_id", "text_hash", "s.*")
    least = F.create_map(*[F.lit(x) for kv in ({"": 2.0} | limits).items() for x in kv])
    chosen = _scored(model, open_.select("doc_id", "text_hash", "start", "rank", "kind", "end", *features(open_))).where(F.col("score") >= F.element_at(least, F.col("kind")))
    return chosen.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "rank", "kind", "end")).alias("more"))


def found_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text -> doc_id, text_hash, base, spans: arrays of struct<start, rank, kind, end>; end is exclusive."""
    rows = stored(proposals(docs), "pii_proposals")
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    more = added(rows, *fitted(rows)[:2])
    more = more.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "more")
    joined = rows.join(more, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    return joined.select("doc_id", "text_hash", "base", F.concat("base", F.coalesce("more", none)).alias("spans"))


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, text -> doc_id, base, spans: arrays of struct<start, rank, kind, end>; end is exclusive."""
    return found_spans(docs).drop("text_hash")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id, text -> doc_id, text, kind, start, end: PLANTED texts of the corpus for each kind, each with one made-up
    personal span between two of its words, in a sentence that the trees may or may not have seen."""
    spark = docs.sparkSession
    own = docs.select(text_of().alias("text")).where(F.length("text") > 200).select("text", F.xxhash64("text").alias("draw")).distinct()
    own = own.withColumn("place", F.row_number().over(Window.orderBy("draw"))).where(F.col("place") <= PLANTED * len(KINDS))
    made = examples(spark).where("label = 1").withColumn("turn", F.row_number().over(Window.partitionBy("kind").orderBy("doc_id"))).where(F.col("turn") <= PLANTED)
    made = made.withColumn("place", (F.col("turn") - 1) * len(KINDS) + F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i + 1)]), F.col("kind")))
    cut = F.call_function("locate", F.lit(" "), F.col("text"), F.floor(F.length("text") / 2).cast("int"))
    rows = own.join(made.select("place", "doc_id", "kind", "before", "hit"), "place").withColumn("cut", cut).where(F.col("cut") > 0)
    start = F.col("cut") + F.length("before")
    text = F.concat(F.substr("text", F.lit(1), F.col("cut")), "before", "hit", F.substr("text", F.col("cut")))
    return rows.select("doc_id", text.alias("text"), "kind", start.alias("start"), (start + F.length("hit")).alias("end"))


def calibration(docs: DataFrame) -> DataFrame:
    """doc_id, text -> kind, part, threshold, rows (all that are labelled), precision and recall of the kind's threshold on
    them, each scored by trees that saw none of its siblings.

    Part `planted`: spans in loose formats, which no base span covers, planted into texts of the corpus; recall only.
    """
    spark = docs.sparkSession
    model, limits, report = fitted(stored(proposals(docs), "pii_proposals"))
    held_in = stored(planted(docs), "pii_planted")
    rows = stored(proposals(held_in.select("doc_id", "text")), "pii_planted_proposals")
    asked = held_in.select("doc_id", "kind", "start", "end").join(rows.select("doc_id", "base"), "doc_id")
    asked = asked.where(~F.exists("base", lambda b: (b["kind"] == F.col("kind")) & (b["start"] <= F.col("start")) & (F.col("end") <= b["end"])))
    got = added(rows, model, limits).select("doc_id", F.explode("more").alias("s")).select("doc_id", "s.kind", "s.start", "s.end").withColumn("got", F.lit(1))
    told = asked.join(got, ["doc_id", "kind", "start", "end"], "left").groupBy("kind").agg(F.count("*").alias("n"), F.avg(F.coalesce("got", F.lit(0))).alias("recall")).collect()
    report += [(r["kind"], "planted", limits.get(r["kind"]), r["n"], None, r["recall"]) for r in told]
    return spark.createDataFrame(report, "kind string, part string, threshold double, rows long, precision double, recall double")


def redact(docs: DataFrame, mask: str = "[{}]") -> DataFrame:
    """doc_id, text -> doc_id, text with every span replaced; overlapping spans become one, named after the first."""
    found = found_spans(docs.select("doc_id", "text")).select("doc_id", "text_hash", F.explode("spans").alias("s")).distinct()
    order = Window.partitionBy("doc_id", "text_hash").orderBy("s.start", "s.rank", "s.end").rowsBetween(Window.unboundedPreceding, -1)
    upto = F.coalesce(F.max("s.end").over(order), F.lit(0))  # where the spans before this one end
    cuts = found.select("doc_id", "text_hash", F.struct(upto.alias("from"), F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.kind").alias("kind")).alias("c"))
    cuts = cuts.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.array_sort(F.collect_list("c")).alias("_cuts"), F.max("c.end").alias("_end"))
    rows = docs.select("doc_id", text_of().alias("_text")).withColumn("_text_hash", F.xxhash64("_text"))
    rows = rows.join(cuts, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash")), "left")
    # Characters once as an array, so that a piece costs its own length.
    piece = lambda chars, at, n: F.array_join(F.slice(chars, at + 1, n), "")
    label = lambda c: F.when(c["start"] >= c["from"], F.format_string(mask.replace("{}", "%s"), c["kind"])).otherwise("")
    parts = lambda chars: F.concat(F.transform("_cuts", lambda c: F.concat(piece(chars, c["from"], F.greatest(c["start"] - c["from"], F.lit(0))), label(c))), F.array(piece(chars, F.col("_end"), F.greatest(F.size(chars) - F.col("_end"), F.lit(0)))))
    return rows.select("doc_id", F.when(F.col("_cuts").isNull(), F.col("_text")).otherwise(held(F.split("_text", ""), lambda chars: F.array_join(parts(chars), ""))).alias("text"))


def op8_pii(spark, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined_spans(F.col("base")), 256).alias("base_sha256"), joined_spans(F.col("spans")).alias("spans"))
