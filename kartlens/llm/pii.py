"""Personal data: candidate generators, boosted trees, calibrated thresholds.

Generators of high recall propose overlapping spans for four kinds (email,
ip, card, phone): the base patterns and looser forms of each (spelled-out
addresses, numbers with other separators, numbers without a plus sign).
Boosted trees score a candidate from its format and its context; they learn
from the base rule's verdict on the base pattern's matches (a bounded sample
for each kind and verdict), and each kind's threshold is calibrated on all
other matches of all documents. Spans accepted by the base rule always stay; a looser
candidate is added when it reaches its kind's threshold and overlaps no base
span.

Everything on the data path is DataFrame expressions: regular expressions for
the generators, sums of CASE trees for the scores, so that no document is
shuffled. Patterns are written without backtracking (possessive parts, starts
tied to the start of a run); positions, overlaps and cuts come from running
sums, running maxima and bisection over the matches, never from a pass over
all of them for each, so very long texts take time near linear in text and
matches.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kartlens.llm.common import stage

KINDS = ("email", "ip", "card", "phone")
# The base patterns. Starts may follow the end of the last
# match (\G) or a character that can't belong to the same run.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
IP_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9][0-9]?)"
IP_VALID = rf"^{IP_PART}(?:\.{IP_PART}){{3}}$"
# Looser forms: spelled-out addresses, bracketed dots, other separators,
# national numbers. A text is searched only if it holds the hint.
LOOSE = {
    "email": (
        r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?:"
        r"\x20?[(\[{]at[)\]}]\x20?[A-Za-z0-9-]{1,63}+(?:\x20?[(\[{]dot[)\]}]\x20?[A-Za-z0-9-]{1,63}+|\.[A-Za-z0-9-]{1,63}+){1,4}+"
        r"|\x20at\x20[A-Za-z0-9-]{1,63}+(?:\x20dot\x20[A-Za-z0-9-]{1,63}+){1,4}+)",
        r"(?i)[(\[{]at[)\]}]|\x20dot\x20",
    ),
    "ip": (r"(?<![0-9])[0-9]{1,3}+(?:\[\.\][0-9]{1,3}+){3}+(?![0-9])", r"[0-9]\[\.\][0-9]"),
    "card": (r"(?<![0-9])[0-9]{4}+(?:[.\x20_/-]{1,2}+[0-9]{4}+){3}+(?![0-9])", r"[0-9]{4}[.\x20_/-]{1,2}[0-9]{4}"),
    "phone": (
        r"(?<![0-9A-Za-z])(?:00[0-9]{1,3}+[\x20.-])?+\(?[0-9]{3}\)?[\x20.-]{1,2}+[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
        r"[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}",
    ),
}
# Words before a span that name its kind.
CUES = {
    "email": r"(?i)(?:mail|contact|write|address)\W{0,3}(?:\w+\W+)?$",
    "ip": r"(?i)(?:\bip|host|server|address)\W{0,3}(?:\w+\W+)?$",
    "card": r"(?i)(?:card|visa|credit|account|pay)\W{0,3}(?:\w+\W+)?$",
    "phone": r"(?i)(?:phone|tel|call|mobile|fax|dial)\W{0,3}(?:\w+\W+)?$",
}
BLOCK = 256  # characters of a text that are cut at a time
CONTEXT = 24  # characters before a span that are context
MAX_TRAIN = 4_000  # distinct candidates of a kind and verdict that may train
TREES, DEPTH = 8, 3
PRECISION = 0.98  # that a kind's threshold must reach on unseen matches
NEVER = 2.0  # the threshold of a kind that nothing was learned about


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(number)),
        F.lit(0),
        lambda acc, i: acc + _luhn_digit(F.substring(F.reverse(number), i, F.lit(1)).cast("int"), i),
    )
    return (F.length(number) > 0) & (F.pmod(total, F.lit(10)) == 0)


def _luhn_digit(d: Column, i: Column) -> Column:
    doubled = d * 2 - F.when(d > 4, 9).otherwise(0)
    return F.when(F.pmod(i, F.lit(2)) == 0, doubled).otherwise(d)


def valid(kind: str, match: Column) -> Column:
    """The base rule of a kind on a match of its base pattern."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return match.rlike(IP_VALID)
    n = F.length(digits(match))
    if kind == "card":
        return F.when(n.between(16, 19), luhn(digits(match))).otherwise(F.lit(False))
    return n.between(8, 15)


def bound(value: Column, fn) -> Column:
    """``fn`` of ``value``, which is computed once however often it is used."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def running(values: Column, combine) -> Column:
    """The running ``combine`` (sum or greatest) over an array without nulls:
    after step k every element holds that of the last 2^k up to it."""

    def step(acc: Column, k: Column) -> Column:
        return F.transform(
            acc, lambda v, i: bound(F.get(acc, i - F.call_function("shiftleft", F.lit(1), k)), lambda e: F.when(e.isNull(), v).otherwise(combine(e, v)))
        )

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(values) + F.lit(1))).cast("int"))
    return F.aggregate(steps, values, step)


def count_below(rising: Column, x: Column) -> Column:
    """How many elements of a sorted array are less than ``x``, by bisection."""
    steps = F.sequence(F.ceil(F.log2(F.size(rising) + F.lit(1))).cast("int"), F.lit(0))

    def step(n: Column, k: Column) -> Column:
        ahead = n + F.call_function("shiftleft", F.lit(1), k)
        return F.when(F.get(rising, ahead - 1) < x, ahead).otherwise(n)

    return F.aggregate(steps, F.lit(0), step)


def found(text: Column, pattern: str, hint: str) -> Column:
    """array<struct<start, match, before>> of the pattern's leftmost
    non-overlapping matches; positions in code points. What lies between the
    matches gives their positions by a running sum, so the text is read a
    fixed number of times."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def located(pieces: Column) -> Column:
        lengths = F.transform(
            pieces, lambda x: (F.length(x["gap"]) + F.coalesce(F.length(x["match"]), F.lit(0))).cast("long")
        )
        placed = F.zip_with(
            pieces,
            running(lengths, lambda a, b: a + b),
            lambda x, end: F.struct(
                (end - F.length(x["match"])).alias("start"),
                x["match"].alias("match"),
                F.substring(x["gap"], -CONTEXT, CONTEXT).alias("before"),
            ),
        )
        return F.filter(placed, lambda x: x["match"].isNotNull()).cast(_LOCATED)

    every = bound(F.arrays_zip(gaps.alias("gap"), matches.alias("match")), located)
    return F.when(text.rlike(hint), every).otherwise(F.array().cast(_LOCATED))


_LOCATED = "array<struct<start:bigint,match:string,before:string>>"
# A text without the hint can't match the base pattern.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]"}


def features(match: Column, before: Column, kind: Column) -> dict[str, Column]:
    """Format and context of a candidate; ``kind`` is the index in KINDS."""
    n = F.length(digits(match))
    numbers = F.split(match, "[^0-9]+")
    cue = F.lit(False)
    for k, name in enumerate(KINDS):
        cue = F.when(kind == k, before.rlike(CUES[name])).otherwise(cue)
    return {
        "kind": kind.cast("double"),
        "length": F.length(match).cast("double"),
        "digits": n.cast("double"),
        "separators": F.length(F.regexp_replace(match, "[0-9A-Za-z]", "")).cast("double"),
        "groups": F.size(F.split(match, "[^0-9A-Za-z]+")).cast("double"),
        "longest_number": F.array_max(F.transform(numbers, F.length)).cast("double"),
        "largest_number": F.coalesce(
            F.array_max(F.transform(numbers, lambda s: F.substring(s, 1, 6).try_cast("double"))), F.lit(0.0)
        ),
        "checksum": F.when(n.between(12, 19), luhn(digits(match))).otherwise(F.lit(False)).cast("double"),
        "leading_zero": match.rlike(r"^\+?0").cast("double"),
        "cue": cue.cast("double"),
        "after_letter": before.rlike("[A-Za-z]$").cast("double"),
        "after_symbol": before.rlike(r"[^A-Za-z0-9\s]$").cast("double"),
    }


@dataclass(frozen=True)
class Model:
    """Boosted trees as nested (feature, split, left, right) tuples with float
    leaves, their weights, and a threshold for each kind."""

    names: tuple[str, ...] = ()
    trees: tuple = ()
    weights: tuple[float, ...] = ()
    thresholds: tuple[float, ...] = (NEVER,) * len(KINDS)

    def score(self, values: Column) -> Column:
        """Probability from a struct of features."""

        def case(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            feature, split, left, right = node
            return F.when(values[self.names[feature]] <= split, case(left)).otherwise(case(right))

        margin = reduce(
            lambda acc, tw: acc + case(tw[0]) * tw[1], zip(self.trees, self.weights, strict=True), F.lit(0.0)
        )
        return F.lit(1.0) / (F.lit(1.0) + F.exp(margin * -2))


def _tree(lines: list[str]):
    """The tree of Spark ML's indented description, as nested tuples."""
    line = lines.pop(0)
    if line.startswith("Predict:"):
        return float(line.split(":")[1])
    feature, split = line.removeprefix("If (feature ").rstrip(")").split(" <= ")
    left = _tree(lines)
    lines.pop(0)  # Else
    return int(feature), float(split), left, _tree(lines)


def base_candidates(docs: DataFrame) -> DataFrame:
    """(label, features ..., n): how many matches of the base patterns are
    alike in verdict and features; kind is one of the features."""
    located = docs.select(*[found(F.col("text"), BASE[k], HINTS[k]).alias(k) for k in KINDS])
    each = reduce(
        DataFrame.union,
        [
            located.select(F.lit(i).alias("kind"), F.explode(k).alias("x")).select(
                "kind", "x.match", "x.before", valid(k, F.col("x.match")).cast("double").alias("label")
            )
            for i, k in enumerate(KINDS)
        ],
    )
    made = features(F.col("match"), F.col("before"), F.col("kind"))
    rows = each.select("label", *[c.alias(n) for n, c in made.items()])
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))


def _dealt(rows: DataFrame, max_train: int) -> DataFrame:
    """``rows`` with ``trains``, how many of the ``n`` alike matches train; the
    others calibrate. Up to ``max_train`` rows of a kind and verdict, by hash,
    give half of their matches; of those with one match every second row, from
    the first, gives it."""
    per = rows.groupBy("kind", "label").agg(F.count(F.lit(1)).alias("rows")).collect()  # at most 2 a kind
    places = 1 << 40
    limit = F.lit(places)
    for r in per:
        here = (F.col("kind") == r["kind"]) & (F.col("label") == r["label"])
        limit = F.when(here, F.lit(min(places, max_train * places // r["rows"]))).otherwise(limit)
    values = [c for c in rows.columns if c != "n"]
    rows = rows.withColumn("place", F.xxhash64(*values)).withColumn("taken", F.pmod("place", F.lit(places)) < limit)
    rare = W.partitionBy("kind", "label", F.col("n") == 1).orderBy("place", *values)
    taken = rows.where("taken").withColumn("nth", F.row_number().over(rare))
    trains = F.when(F.col("n") > 1, F.floor(F.col("n") / 2)).otherwise(F.col("nth") % 2).cast("long")
    taken = taken.select(*values, "n", trains.alias("trains"))
    return taken.unionByName(rows.where("not taken").select(*values, "n", F.lit(0).cast("long").alias("trains")))


def fit(docs: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """Trees learned from the base rule's verdicts on matches of all
    documents: a sample of up to ``max_train`` distinct candidates of each
    kind and verdict trains, all other matches calibrate the thresholds.
    Without both verdicts in the documents nothing is learned and nothing is
    added; a kind of which no match calibrates, or whose matches nowhere reach
    the precision, is not added."""
    counted = stage(base_candidates(docs), "pii-candidates")
    rows = stage(_dealt(counted, max_train), "pii-dealt")
    names = tuple(c for c in rows.columns if c not in ("label", "n", "trains"))
    vectors = VectorAssembler(inputCols=list(names), outputCol="features").transform(rows.where(F.col("trains") > 0))
    train = vectors.select("features", "label", F.col("trains").cast("double").alias("weight"))
    if train.select("label").distinct().count() < 2:
        return Model()
    learner = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7, weightCol="weight")
    learned = learner.fit(train)
    trees = tuple(
        _tree([line.strip() for line in t.toDebugString.splitlines()[1:] if line.strip()]) for t in learned.trees
    )
    model = Model(names, trees, tuple(learned.treeWeights))
    unseen = rows.withColumn("n", F.col("n") - F.col("trains")).where(F.col("n") > 0)
    return Model(names, trees, model.weights, _thresholds(unseen, model))


def _thresholds(rows: DataFrame, model: Model) -> tuple[float, ...]:
    """For each kind the lowest score, in steps of a hundredth from 0.5, from
    which on the precision over all ``n`` matches is at least ``PRECISION``."""
    score = model.score(F.struct(*[F.col(n) for n in model.names]))
    step = F.greatest(F.floor(score * 100), F.lit(0)).alias("step")
    counts = (
        rows.select(F.col("kind").cast("int").alias("kind"), "label", "n", step)
        .groupBy("kind", "step")
        .agg(F.sum(F.col("label") * F.col("n")).alias("true"), F.sum("n").alias("n"))
        .collect()  # at most 101 rows a kind
    )
    out = []
    for k in range(len(KINDS)):
        best, right, every = NEVER, 0.0, 0
        for r in sorted((r for r in counts if r["kind"] == k and r["step"] >= 50), key=lambda r: -r["step"]):
            right, every = right + r["true"], every + r["n"]
            if right / every >= PRECISION:
                best = r["step"] / 100
        out.append(best)
    return tuple(out)


def _span(kind: int, x: Column, base: bool) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"),
        x["start"].alias("start"),
        (x["start"] + F.length(x["match"])).alias("end"),
        F.lit(base).alias("base"),
    )


def _overlaps(spans: Column, fn) -> Column:
    """``fn`` of a test whether a (start, end) overlaps one of ``spans``: of
    those that start before its end the greatest end lies beyond its start."""
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))

    def over(b: Column) -> Column:
        parts = F.struct(
            F.transform(b, lambda s: s["start"]).alias("starts"),
            running(F.transform(b, lambda s: s["end"]), F.greatest).alias("reach"),
        )
        return bound(
            parts,
            lambda p: fn(
                lambda start, end: F.coalesce(F.get(p["reach"], count_below(p["starts"], end) - 1) > start, F.lit(False))
            ),
        )

    return bound(by_start, over)


def spans(docs: DataFrame, model: Model, column: str = "__spans") -> DataFrame:
    """``docs`` with an array of (kind, start, end, base) by kind and start as
    ``column``; kind is the index in KINDS, positions are code points.

    Null and empty texts have no spans. Spans of different kinds may overlap;
    an added span overlaps no base span. Repeated rows are searched each;
    other columns pass through, whatever their names, but one named
    ``column``, in place of which the spans stand; no shuffle."""
    packed = _searched(docs, model)
    return packed.select(
        *[F.col("doc")[c].alias(c) for c in docs.columns if c.lower() != column.lower()], F.col("spans").alias(column)
    )


def _searched(docs: DataFrame, model: Model) -> DataFrame:
    """(doc, spans): each row of ``docs`` as a struct, and its spans."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    kept = packed.select("doc", F.coalesce(F.col("doc.text"), F.lit("")).alias("text"))
    kept = kept.select("*", *[found(F.col("text"), BASE[k], HINTS[k]).alias(f"base{i}") for i, k in enumerate(KINDS)])

    def accepted(i: int, k: str) -> Column:
        good = F.filter(F.col(f"base{i}"), lambda x: F.coalesce(valid(k, x["match"]), F.lit(False)))
        return F.transform(good, lambda x: _span(i, x, True))

    kept = kept.select("doc", "text", F.concat(*[accepted(i, k) for i, k in enumerate(KINDS)]).alias("base"))
    loose = [i for i in range(len(KINDS)) if model.thresholds[i] < NEVER]
    if not loose:
        return kept.select("doc", F.col("base").alias("spans"))
    kept = kept.select("*", *[found(F.col("text"), *LOOSE[KINDS[i]]).alias(f"loose{i}") for i in loose])

    def added(i: int) -> Column:
        scored = F.transform(
            F.col(f"loose{i}"),
            lambda x: F.struct(
                _span(i, x, False).alias("span"),
                F.struct(
                    *[c.alias(n) for n, c in features(x["match"], x["before"], F.lit(i)).items()]
                ).alias("values"),
            ),
        )
        good = F.filter(scored, lambda y: model.score(y["values"]) >= model.thresholds[i])
        return F.transform(good, lambda y: y["span"])

    kept = kept.select("doc", "base", F.concat(*[added(i) for i in loose]).alias("added"))
    apart = _overlaps(F.col("base"), lambda meets: F.filter("added", lambda s: ~meets(s["start"], s["end"])))
    every = F.when(F.size("added") > 0, F.sort_array(F.concat("base", apart))).otherwise(F.sort_array("base"))
    return kept.select("doc", every.alias("spans"))


def listed(found_spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            found_spans,
            lambda s: F.concat_ws(
                ":", F.element_at(kind, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")
            ),
        ),
        ",",
    )


def cut_out(text: Column, taken: Column, tags: Column) -> Column:
    """``text`` with its ``taken`` spans, (start, end, kind) by start, replaced
    by their tags; of overlapping ones only the first gets a tag. The text is
    cut into blocks of ``BLOCK`` characters once, and every piece between
    spans is taken from the blocks it lies in."""

    def joined(p: Column) -> Column:
        def piece(a: Column, b: Column) -> Column:
            def part(j: Column) -> Column:
                start = F.greatest(a - j * BLOCK, F.lit(0))
                upto = F.least(b - j * BLOCK, F.lit(BLOCK))
                return F.substring(F.get(p["blocks"], j.cast("int")), (start + 1).cast("int"), (upto - start).cast("int"))

            blocks = F.sequence(F.floor(a / BLOCK), F.floor((b - 1) / BLOCK))
            return F.when(a < b, F.array_join(F.transform(blocks, part), "")).otherwise("")

        def replaced(s: Column, i: Column) -> Column:
            at = F.coalesce(F.get(p["reach"], i - 1), F.lit(0).cast("long"))
            tagged = F.concat(piece(at, s["start"]), F.element_at(tags, s["kind"] + 1))
            return F.when(s["start"] >= at, tagged).otherwise("")

        last = F.get(p["reach"], F.size(p["reach"]) - 1)
        return F.concat(F.array_join(F.transform(taken, replaced), ""), piece(last, F.length(text).cast("long")))

    parts = F.struct(
        F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)).alias("blocks"),
        running(F.transform(taken, lambda s: s["end"]), F.greatest).alias("reach"),
    )
    return bound(parts, joined)


def redacted(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in brackets
    (overlapping spans by that of the first), and ``n_chars``, if there is
    such a column, counted anew. Texts without spans stay as they are; other
    columns pass through, whatever their names."""
    tags = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    by_start = F.array_sort(
        F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    )
    changed = bound(by_start, lambda taken: cut_out(F.col("doc.text"), taken, tags))
    out = _searched(docs, model).select(
        "doc", F.when(F.size("spans") > 0, changed).otherwise(F.col("doc.text")).alias("text")
    )
    made = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[made.get(c, F.col("doc")[c]).alias(c) for c in docs.columns])
