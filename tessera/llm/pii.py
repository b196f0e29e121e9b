"""Personal data by candidate generators and boosted trees (operator 13, native).

Base patterns find e-mail addresses, IPv4 addresses, card numbers and phone
numbers, each kind by itself; matches that fail their check (parts, digits,
Luhn) are dropped.  A pattern takes as much as it can, so neighbours may spoil a
match: a phone number followed by a card number is one match of too many digits.
Generators of high recall therefore propose further, overlapping spans, and
boosted trees judge each by its format and context.

The trees learn from the corpus itself: a candidate that is a base span of its
kind is a positive; one that the base pattern matched as such and dropped, or
that crosses base spans, or that no pattern touched, a negative; one inside a
longer match that was dropped, or an address written around its ``@``, is what
they are meant to decide, and teaches nothing.  The fit takes every candidate
that teaches, equal ones as one row with their number, in Spark: a level of a
tree is one job that sums gradients per node, feature and code, in whole
numbers, so that neither order nor partitions change a tree; the driver gets
these sums (at most ``CUTS`` + 1 a node and feature) and picks the splits.
Scores of two-fold cross fitting calibrate a threshold per kind: the smallest at
which ``precision`` of the candidates above it are positives.  A kind without
``LEAST`` candidates of both sorts adds nothing.

Base spans stay.  An added span crosses none of them, and of added spans that
cross each other the one of the higher score (then the longer, the earlier, the
kind listed first) goes before: a span goes if a better one crosses it.

All of it is DataFrame functions, the search without a shuffle (the fit shuffles
counts of equal candidates).  Digits and their punctuation are cut out of a text as regions first, as no match of these kinds
crosses a region's end; every pattern is bounded or possessive, so that a long
run of digits or letters is read once.  A candidate has at least seven
characters, so only ``NEAR`` neighbours in the order of starts can cross it.

Defined results: null and empty texts have no spans; every row gives a row,
null and repeated ids included; an empty table, or one without a candidate,
adds nothing.  Only doc_id and text are read; ``redacted`` keeps all
columns.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions.schema_text import let
from tessera.llm.features import sigmoid
from tessera.session import scratch_path

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
LOCAL = "A-Za-z0-9._%+-"
#: Base patterns.  A run is entered at its start or where the last match ended:
#: what fails there fails from every later place in the run.
BASE = {
    EMAIL: rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    IP: r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    CARD: r"[0-9](?:[ -]?[0-9])++",
    PHONE: r"\+[0-9][ ().0-9-]+[0-9]",
}
REGION = r"[0-9+(][0-9+(). -]{6,}+"
WRITTEN_EMAIL = (rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++(?:@| ?[(\[] ?at ?[)\]] ?)[A-Za-z0-9-]++"
                 r"(?:(?:\.| ?[(\[] ?dot ?[)\]] ?)[A-Za-z0-9-]++)*+")
#: Generators within regions, by kind.
GENERATORS = [
    (IP, r"(?<![0-9])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])"),
    (CARD, r"(?<![0-9])[0-9]{14,19}(?![0-9])"),
    (CARD, r"(?<![0-9])[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{2,7}(?![0-9])"),
    (CARD, r"(?<![0-9])[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}(?![0-9])"),
    (PHONE, r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])"),
    (PHONE, r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"),
]
FEATURES = ("digits", "chars", "luhn", "marks", "groups", "first", "last", "plus", "bracket", "value", "left", "right", "keyed")
NEAR = 31
LEAST = 5
ROUNDS, DEPTH, RATE, RIDGE = 12, 3, 0.5, 1.0
CUTS = 64
#: Gradients are summed as multiples of 1 / UNIT; scores are calibrated on
#: multiples of 1 / GRID up to TOP, which bounds what the driver gets.
UNIT, GRID, TOP = 1 << 24, 1024, 32


# --- boosted trees ---------------------------------------------------------

Tree = tuple | float        # (feature, threshold, tree at or below it, tree above it)


def grow(codes: np.ndarray, cuts: list[np.ndarray], gradient: np.ndarray, curvature: np.ndarray, rows: np.ndarray, depth: int) -> Tree:
    """Tree of the largest second-order gain; leaves hold the step."""
    g, h = gradient[rows].sum(), curvature[rows].sum()
    best = (1e-6, None)
    for k, cut in enumerate(cuts if depth else []):
        g_low, h_low = (np.cumsum(np.bincount(codes[rows, k], v[rows], len(cut) + 1))[:-1] for v in (gradient, curvature))
        gain = g_low ** 2 / (h_low + RIDGE) + (g - g_low) ** 2 / (h - h_low + RIDGE) - g ** 2 / (h + RIDGE)
        if len(gain) and gain.max() > best[0]:
            best = (gain.max(), (k, int(gain.argmax())))
    if best[1] is None:
        return float(-RATE * g / (h + RIDGE))
    k, at = best[1]
    low = codes[rows, k] <= at
    return (k, float(cuts[k][at]), *(grow(codes, cuts, gradient, curvature, rows[part], depth - 1) for part in (low, ~low)))


def tree_values(tree: Tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    k, cut, low, high = tree
    return np.where(x[:, k] <= cut, tree_values(low, x), tree_values(high, x))


def boost(x: np.ndarray, y: np.ndarray) -> list[Tree]:
    """Trees whose sum is the log-odds of y: the plain form, on arrays, of what
    ``fit`` does in Spark."""
    cuts = []
    for k in range(x.shape[1]):
        values = np.unique(x[:, k])
        between = (values[1:] + values[:-1]) / 2
        cuts.append(between if len(between) <= CUTS else np.unique(np.quantile(between, np.linspace(0, 1, CUTS))))
    codes = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], axis=1)
    margin, trees = np.zeros(len(x)), []
    for _ in range(ROUNDS):
        p = sigmoid(margin)
        trees.append(grow(codes, cuts, p - y, p * (1 - p), np.arange(len(x)), DEPTH))
        margin = margin + tree_values(trees[-1], x)
    return trees


def margins(trees: list[Tree], x: np.ndarray) -> np.ndarray:
    return sum((tree_values(t, x) for t in trees), np.zeros(len(x)))


def calibrated(scores: np.ndarray, y: np.ndarray, precision: float, n: np.ndarray | None = None) -> float | None:
    """Smallest threshold such that of the scores from it on, ``precision``
    belong to positives; halfway down to the next lower score.  With ``n``, a
    score stands for so many candidates, ``y`` of them positives."""
    order = np.argsort(-scores, kind="stable")
    s, right = scores[order], np.cumsum(y[order]) / np.cumsum(np.ones(len(y)) if n is None else n[order])
    whole = np.append(s[:-1] > s[1:], True)     # ties stay together
    fine = np.flatnonzero(whole & (right >= precision))
    if not len(fine):
        return None
    last = fine[-1]
    return float((s[last] + s[last + 1]) / 2) if last + 1 < len(s) else float(s[last] - 1e-6)


@dataclass
class Detector:
    """Per kind that adds spans: its trees and its threshold."""

    trees: dict[int, list[Tree]] = field(default_factory=dict)
    thresholds: dict[int, float] = field(default_factory=dict)


def tree_column(tree: Tree, features: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(tree)
    k, cut, low, high = tree
    return F.when(F.get(features, F.lit(k)) <= cut, tree_column(low, features)).otherwise(tree_column(high, features))


# --- spans by column functions --------------------------------------------

def running_sums(values: Column, chunk: int = 256) -> Column:
    """Running sums of an int array, in chunks: appending to one array would
    take the square of its length."""
    def sums(part: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda s, x: F.struct((s["at"] + x).alias("at"), F.array_append(s["out"], s["at"] + x).alias("out"))
        return F.aggregate(part, start, step, lambda s: s["out"])

    def cut(xs: Column) -> Column:
        firsts = F.when(F.size(xs) > 0, F.sequence(F.lit(1), F.size(xs), F.lit(chunk))).otherwise(F.array().cast("array<int>"))
        return F.transform(firsts, lambda i: sums(F.slice(xs, i, F.lit(chunk))))

    shifted = lambda p: let(sums(F.transform(p, lambda q: F.element_at(q, -1))), lambda ends: F.flatten(
        F.transform(p, lambda q, i: F.transform(q, lambda v: v + F.when(i == 0, 0).otherwise(F.get(ends, i - 1))))))
    return let(let(values, cut), shifted)


def located(text: Column, pattern: str) -> Column:
    """array<struct<start, text, left, right>>: the matches with the two
    characters on either side (fewer at another match or an end)."""
    def build(gaps: Column, found: Column) -> Column:
        steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.length(g) + F.length(m))
        return let(running_sums(steps), lambda ends: F.transform(found, lambda m, i: F.struct(
            (F.get(ends, i) - F.length(m)).alias("start"), m.alias("text"), F.right(F.get(gaps, i), F.lit(2)).alias("left"),
            F.left(F.get(gaps, i + 1), F.lit(2)).alias("right"))))

    none = F.array().cast("array<struct<start:int,text:string,left:string,right:string>>")
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) == 0, none).otherwise(
        let(F.split(text, pattern, -1), lambda gaps: build(gaps, found))))


def in_region(region: Column, pattern: str) -> Column:
    """``located`` in a region, with places and sides in the whole text."""
    size = F.length(region["text"])
    return F.transform(located(region["text"], pattern), lambda m: F.struct(
        (region["start"] + m["start"]).alias("start"), m["text"].alias("text"),
        F.when(m["start"] == 0, region["left"]).otherwise(m["left"]).alias("left"),
        F.when(m["start"] + F.length(m["text"]) == size, region["right"]).otherwise(m["right"]).alias("right")))


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def small_number(text: Column) -> Column:
    """The number that digits spell, 999 if it has more than three figures."""
    figures = F.ltrim(text, F.lit("0"))
    return F.when(F.length(figures) > 3, 999).otherwise(F.coalesce(figures.try_cast("int"), F.lit(0)))


def passes(kind: int, text: Column) -> Column:
    if kind == EMAIL:
        return F.lit(True)
    if kind == IP:
        return F.forall(F.split(text, r"\."), lambda p: small_number(p) <= 255)
    n = F.length(digits_of(text))
    return n.between(10, 15) if kind == PHONE else n.between(14, 19) & luhn(digits_of(text))


def side_class(char: Column) -> Column:
    """0 blank or end, 1 letter, 2 digit, 3 anything else."""
    return (F.when(F.trim(char) == "", 0.0).when(char.rlike("[0-9]"), 2.0).when(char.rlike(r"\p{L}"), 1.0)
            .when(char.rlike(r"\s"), 0.0).otherwise(3.0))


def features(kind: int, m: Column) -> Column:
    """array<double> in the order of ``FEATURES``."""
    text, digits = m["text"], digits_of(m["text"])
    parts = F.split(text, r"[.]|\[ ?dot ?\]|\( ?dot ?\)|@| ?[(\[] ?at ?[)\]] ?") if kind == EMAIL else F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0))
    last = F.element_at(parts, -1)
    value = last.rlike("^[A-Za-z]+$").cast("double") if kind == EMAIL else F.array_max(F.transform(parts, small_number))
    values = [F.length(digits), F.length(text), luhn(digits), F.length(F.regexp_replace(text, "[A-Za-z0-9]", "")), F.size(parts),
              F.length(F.element_at(parts, 1)), F.length(last), text.startswith("+"), text.contains("("), value,
              side_class(F.right(m["left"], F.lit(1))), side_class(F.left(m["right"], F.lit(1))), m["left"].rlike("[=:\"']")]
    return F.array(*(F.coalesce(v.cast("double"), F.lit(0.0)) for v in values))


BASE_SPAN, DROPPED, CANDIDATE = range(3)


def mark(kind: int, m: Column, sort: Column, f: Column) -> Column:
    return F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), (m["start"] + F.length(m["text"])).alias("end"),
                    sort.alias("sort"), f.alias("f"))


def marks(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_marks``: base spans, dropped matches and candidates of
    each text, by start, kind and end."""
    text = F.coalesce(F.col("_text"), F.lit(""))
    has_at = text.contains("@") | text.rlike(r"[(\[] ?at ?[)\]]")
    none = F.array().cast("array<struct<start:int,text:string,left:string,right:string>>")
    found = docs.withColumn("_regions", located(text, REGION)) \
        .withColumn("_base_emails", F.when(text.contains("@"), located(text, BASE[EMAIL])).otherwise(none)) \
        .withColumn("_emails", F.when(has_at, located(text, WRITTEN_EMAIL)).otherwise(none))
    no_features = F.lit(None).cast("array<double>")
    checked = lambda kind, ms: F.transform(ms, lambda m: mark(
        kind, m, F.when(passes(kind, m["text"]), BASE_SPAN).otherwise(DROPPED), no_features))
    proposed = lambda kind, ms: F.transform(ms, lambda m: mark(kind, m, F.lit(CANDIDATE), features(kind, m)))
    of_region = lambda r: F.concat(
        *(checked(kind, in_region(r, BASE[kind])) for kind in (IP, CARD, PHONE)), *(proposed(kind, in_region(r, p)) for kind, p in GENERATORS))
    every = F.concat(checked(EMAIL, F.col("_base_emails")), proposed(EMAIL, F.col("_emails")),
                     F.flatten(F.transform("_regions", of_region)))
    return found.withColumn("_marks", F.array_sort(every)).drop("_regions", "_base_emails", "_emails")


def neighbours(items: Column, at: Column) -> Column:
    return F.slice(items, F.greatest(at + 1 - NEAR, F.lit(1)), F.lit(2 * NEAR + 1))


def crosses(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def same(a: Column, b: Column) -> Column:
    return (a["start"] == b["start"]) & (a["end"] == b["end"]) & (a["kind"] == b["kind"])


def judged(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_marks`` and ``_candidates`` (start, kind, end, f, free:
    crosses no base span, label: 1, 0 or null)."""
    def look(c: Column, near: Column) -> Column:
        any_of = lambda sort, fits: F.exists(near, lambda y: (y["sort"] == sort) & fits(y))
        inside = any_of(DROPPED, lambda y: (y["kind"] == c["kind"]) & crosses(c, y))
        written = (c["kind"] == EMAIL) & (F.get(c["f"], F.lit(FEATURES.index("groups"))) > 2)
        crossed = any_of(BASE_SPAN, lambda y: crosses(c, y))
        label = (F.when(any_of(BASE_SPAN, lambda y: same(c, y)), 1).when(crossed | any_of(DROPPED, lambda y: same(c, y)), 0)
                 .when(inside | written, F.lit(None).cast("int")).otherwise(0))
        return F.struct(c["start"], c["kind"], c["end"], c["sort"], c["f"], (~crossed).alias("free"), label.alias("label"))

    looked = F.transform("_marks", lambda c, i: F.when(c["sort"] == CANDIDATE, look(c, neighbours(F.col("_marks"), i))))
    return marks(docs).withColumn("_candidates", F.filter(looked, lambda c: c.isNotNull()))


def prepared(docs: DataFrame, text: str = "text") -> DataFrame:
    """Each row of ``docs`` as ``_row``, with the marks and candidates of its
    text: what both the fit and the search start from."""
    return judged(docs.select(F.struct("*").alias("_row"), docs[text].cast("string").alias("_text")))


def training_sample(found: DataFrame, sample: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kinds, features, labels) of at most ``sample`` candidates that teach, to
    look at: no fit uses it.  They are
    the first by a hash of their text, place and kind, copies included.  At most
    ``sample`` rows reach the driver, and about twice as many a single task,
    whatever the number of rows and of copies."""
    taught = found.select(
        F.crc32(F.coalesce("_text", F.lit("")).cast("binary")).alias("row"),
        F.explode(F.filter("_candidates", lambda c: c["label"].isNotNull())).alias("c"))
    order = ["h", "kind", "label", "f"]
    rows = taught.select("c.kind", "c.f", "c.label", F.xxhash64("row", "c.start", "c.kind", F.lit(41)).alias("h"))
    # Only hashes below a bound that about twice the sample keeps go on, and
    # copies of a text as one row with their number.
    share = 2 * sample / max(rows.agg(F.count(F.lit(1))).first()[0], 1)
    while True:
        below = rows.filter(F.col("h") < -(1 << 63) + int(share * (1 << 64))) if share < 1 else rows
        first = below.groupBy(*order).agg(F.count(F.lit(1)).alias("n")).orderBy(*order).limit(sample).collect()
        if share >= 1 or sum(r["n"] for r in first) >= sample:
            break
        share *= 4
    if not first:
        return np.zeros(0, dtype=int), np.zeros((0, len(FEATURES))), np.zeros(0)
    n = np.array([r["n"] for r in first])
    copies = np.clip(sample - (np.cumsum(n) - n), 0, n)
    every = (np.array([r["kind"] for r in first]), np.array([r["f"] for r in first]), np.array([float(r["label"]) for r in first]))
    return tuple(np.repeat(x, copies, axis=0) for x in every)


def taught(found: DataFrame) -> DataFrame:
    """(kind, fold, label, f, n): every candidate that teaches, equal ones as
    one row.  A hash of its text, place and kind gives a candidate's fold, so
    copies of a text share theirs."""
    each = found.select(F.crc32(F.coalesce("_text", F.lit("")).cast("binary")).alias("row"),
                        F.explode(F.filter("_candidates", lambda c: c["label"].isNotNull())).alias("c"))
    fold = F.pmod(F.xxhash64("row", "c.start", "c.kind", F.lit(41)), F.lit(2)).cast("int")
    return each.select("c.kind", fold.alias("fold"), "c.label", "c.f").groupBy("kind", "fold", "label", "f").agg(
        F.count(F.lit(1)).alias("n"))


def cut_points(rows: DataFrame) -> dict[int, list[list[float]]]:
    """Per kind and feature, the middles between its different values, ``CUTS``
    evenly chosen ones at most."""
    values = rows.select("kind", F.posexplode("f").alias("k", "v")).groupBy("kind", "k").agg(F.array_sort(F.collect_set("v")).alias("v"))
    rest = F.size("v") - 1
    middles = values.select("kind", "k", F.zip_with(F.slice("v", F.lit(1), rest), F.slice("v", F.lit(2), rest), lambda a, b: (a + b) / 2).alias("m"))
    at = lambda i: F.floor(i * (F.size("m") - 1) / (CUTS - 1)).cast("int")
    few = F.when(F.size("m") <= CUTS, F.col("m")).otherwise(F.transform(F.sequence(F.lit(0), F.lit(CUTS - 1)), lambda i: F.get("m", at(i))))
    found: dict[int, list[list[float]]] = {}
    for r in middles.select("kind", "k", few.alias("m")).orderBy("kind", "k").collect():
        found.setdefault(r["kind"], []).append(r["m"])
    return found


def sql_array(values: list, kind: str) -> str:
    return f"cast(array({', '.join(f'{v!r}D' if isinstance(v, float) else str(v) for v in values)}) as array<{kind}>)"


@dataclass
class Heap:
    """A tree by place: 1 is the root, 2 i and 2 i + 1 are below i.  A feature
    of -1 ends a path with the value there."""

    feature: list[int] = field(default_factory=lambda: [-1] * (2 << DEPTH))
    cut: list[int] = field(default_factory=lambda: [0] * (2 << DEPTH))
    value: list[float] = field(default_factory=lambda: [0.0] * (2 << DEPTH))

    def sql(self) -> str:
        return (f"named_struct('feature', {sql_array(self.feature, 'int')}, 'cut', {sql_array(self.cut, 'int')}, "
                f"'value', {sql_array(self.value, 'double')})")

    def tree(self, cuts: list[list[float]], at: int = 1) -> Tree:
        k = self.feature[at]
        return self.value[at] if k < 0 else (k, cuts[k][self.cut[at]], self.tree(cuts, 2 * at), self.tree(cuts, 2 * at + 1))


def place(tree: Column, steps: int) -> Column:
    """Where ``steps`` steps down the heap lead by ``codes``."""
    def step(at: Column, _: Column) -> Column:
        k = F.get(tree["feature"], at)
        return F.when(k < 0, at).otherwise(2 * at + (F.get("codes", k) > F.get(tree["cut"], at)).cast("int"))

    return F.aggregate(F.array(*[F.lit(0)] * steps), F.lit(1), step) if steps else F.lit(1)


def margin(heaps: dict[int, list[Heap]]) -> Column:
    """Sum of the trees of the row's ``fit`` at its ``codes``."""
    if not all(heaps.values()):
        return F.lit(0.0)
    trees = F.expr("map(" + ", ".join(f"{key}, array({', '.join(h.sql() for h in of)})" for key, of in heaps.items()) + ")")
    return F.aggregate(trees[F.col("fit")], F.lit(0.0), lambda s, t: s + let(place(t, DEPTH), lambda at: F.get(t["value"], at)))


def grow_level(heap: Heap, depth: int, sums: dict[tuple[int, int], dict[int, tuple[int, int]]], cuts: list[list[float]]) -> None:
    """Split the nodes of ``depth`` by the sums per (node, feature) and code, as ``grow`` does."""
    leaf = lambda g, h: float(-RATE * g / (h + RIDGE))
    for at in range(1 << depth, 2 << depth):
        best = (1e-6, None)
        for k, cut in enumerate(cuts):
            table = np.zeros((2, len(cut) + 1), dtype=np.int64)
            for code, pair in sums.get((at, k), {}).items():
                table[:, code] = pair
            low = np.cumsum(table, axis=1)
            (g_low, h_low), (g, h) = low[:, :-1] / UNIT, low[:, -1] / UNIT
            if k == 0:
                heap.value[at] = leaf(g, h)
            gain = g_low ** 2 / (h_low + RIDGE) + (g - g_low) ** 2 / (h - h_low + RIDGE) - g ** 2 / (h + RIDGE)
            if len(gain) and gain.max() > best[0]:
                i = int(gain.argmax())
                best = (gain.max(), (k, i, leaf(g_low[i], h_low[i]), leaf(g - g_low[i], h - h_low[i])))
        if best[1] is not None:
            heap.feature[at], heap.cut[at], heap.value[2 * at], heap.value[2 * at + 1] = best[1]


def boosted(rows: DataFrame, cuts: dict[int, list[list[float]]]) -> dict[int, list[Heap]]:
    """Trees per fit of the (kind, fold, label, codes, n) rows: fit 3 kind + f
    learns from the rows outside fold f, and 3 kind + 2 from all."""
    heaps: dict[int, list[Heap]] = {3 * kind + f: [] for kind in cuts for f in range(3)}
    taking = rows.withColumn("fit", F.explode(F.array(3 * F.col("kind") + 1 - F.col("fold"), 3 * F.col("kind") + 2)))
    whole = lambda c: F.round(c * UNIT).cast("long") * F.col("n")
    for _ in range(ROUNDS):
        scored = taking.withColumn("p", 1 / (1 + F.exp(-margin(heaps))))
        steps = scored.select("fit", "codes", whole(F.col("p") - F.col("label")).alias("g"), whole(F.col("p") * (1 - F.col("p"))).alias("h"))
        new = {key: Heap() for key in heaps}
        for depth in range(DEPTH):
            here = F.expr("map(" + ", ".join(f"{key}, {h.sql()}" for key, h in new.items()) + ")")[F.col("fit")]
            sums = steps.withColumn("at", place(here, depth)).where(F.col("at") >= 1 << depth) \
                .select("fit", "at", F.posexplode("codes").alias("k", "code"), "g", "h") \
                .groupBy("fit", "at", "k", "code").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
            found: dict[int, dict] = {key: {} for key in heaps}
            for r in sums.collect():
                found[r["fit"]].setdefault((r["at"], r["k"]), {})[r["code"]] = (r["g"], r["h"])
            for key, heap in new.items():
                grow_level(heap, depth, found[key], cuts[key // 3])
        for key, heap in new.items():
            heaps[key].append(heap)
    return heaps


def fit(found: DataFrame, precision: float = 0.99) -> Detector:
    """The detector that the ``prepared`` rows teach, all of them."""
    spark, detector = found.sparkSession, Detector()

    def stored(df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    rows = stored(taught(found), "pii-taught")
    sorts: dict[int, list[int]] = {}
    for r in rows.groupBy("kind", "label").agg(F.sum("n").alias("n")).collect():
        sorts.setdefault(r["kind"], []).append(r["n"])
    kinds = sorted(k for k, n in sorts.items() if len(n) == 2 and min(n) >= LEAST)
    if not kinds:
        return detector
    rows = rows.where(F.col("kind").isin(kinds))
    cuts = cut_points(rows)
    of_kind = F.expr("map(" + ", ".join(f"{k}, array({', '.join(sql_array(c, 'double') for c in cuts[k])})" for k in kinds) + ")")
    code = lambda v, cs: F.size(F.filter(cs, lambda c: c < v))
    coded = rows.select("kind", "fold", "label", F.zip_with("f", of_kind[F.col("kind")], code).alias("codes"), "n")
    coded = stored(coded.groupBy("kind", "fold", "label", "codes").agg(F.sum("n").alias("n")), "pii-coded")
    heaps = boosted(coded, cuts)
    score = F.greatest(F.lit(-float(TOP)), F.least(F.lit(float(TOP)), margin(heaps)))
    per = coded.withColumn("fit", 3 * F.col("kind") + F.col("fold")).withColumn("score", F.floor(score * GRID) / GRID) \
        .groupBy("kind", "score").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("label")).alias("y")).orderBy("kind", "score").collect()
    for kind in kinds:
        s, y, n = (np.array([r[c] for r in per if r["kind"] == kind], dtype=float) for c in ("score", "y", "n"))
        threshold = calibrated(s, y, precision, n)
        if threshold is not None:
            detector.trees[kind], detector.thresholds[kind] = [h.tree(cuts[kind]) for h in heaps[3 * kind + 2]], threshold
    return detector


def with_spans(found: DataFrame, detector: Detector) -> DataFrame:
    """``_row`` of the ``prepared`` rows with ``spans`` (all) and
    ``base_spans``: arrays of struct<start, kind, end, kind_name> in code
    points, end exclusive, by start and kind."""
    named = lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"),
                               F.get(F.array(*(F.lit(k) for k in KINDS)), c["kind"]).alias("kind_name"))
    own = F.transform(F.filter("_marks", lambda c: c["sort"] == BASE_SPAN), named)

    def score(c: Column) -> Column:
        value = F.lit(None).cast("double")
        for kind, trees in detector.trees.items():
            over = sum((tree_column(t, c["f"]) for t in trees), F.lit(0.0)) - F.lit(detector.thresholds[kind])
            value = F.when(c["kind"] == kind, over).otherwise(value)
        return value

    scored = F.transform(F.filter("_candidates", lambda c: c["free"]), lambda c: F.struct(
        c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"), score(c).alias("score")))
    # Generators may propose one span twice.
    found = found.withColumn("_added", F.array_distinct(F.filter(scored, lambda c: c["score"] >= 0)))
    rank = lambda c: F.struct(c["score"], c["end"] - c["start"], -c["start"], -c["kind"])
    beaten = lambda c, i: F.exists(neighbours(F.col("_added"), i), lambda y: crosses(c, y) & (rank(y) > rank(c)))
    added = F.transform(F.filter("_added", lambda c, i: ~beaten(c, i)), named)
    return found.withColumn("_base", own).withColumn("_all", F.array_sort(F.concat("_base", added))) \
        .select("_row", F.col("_all").alias("spans"), F.col("_base").alias("base_spans"))


def span_list(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind_name"], s["start"], s["end"])), ",")


def redacted(found: DataFrame, detector: Detector, text: str = "text") -> DataFrame:
    """The ``prepared`` rows with each span of ``text`` replaced by its kind in
    brackets; of spans that cross, the first one's."""
    columns = found.schema["_row"].dataType.names
    whole, spans = F.col("_row")[text].cast("string"), F.col("spans")
    before = lambda i: F.coalesce(F.array_max(F.transform(
        F.slice(spans, F.greatest(i + 1 - NEAR, F.lit(1)), F.least(i, F.lit(NEAR))), lambda s: s["end"])), F.lit(0))
    piece = lambda s, i: let(before(i), lambda at: F.when(
        s["start"] >= at, F.concat(F.substring(whole, at + 1, s["start"] - at), F.lit("["), F.upper(s["kind_name"]), F.lit("]")))
        .otherwise(F.lit("")))
    end = F.coalesce(F.array_max(F.transform(spans, lambda s: s["end"])), F.lit(0))
    clean = F.concat(F.array_join(F.transform(spans, piece), ""), F.substring(whole, end + 1, F.length(whole)))
    clean = F.when(F.size(spans) > 0, clean).otherwise(whole)
    cleaned = with_spans(found, detector).select("_row", clean.alias("_clean"))
    return cleaned.select(*(F.col("_clean").alias(c) if c == text else F.col("_row")[c].alias(c) for c in columns))


def find_personal_data(docs: DataFrame, precision: float = 0.99) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)."""
    found = prepared(docs.select("doc_id", "text"))
    found = with_spans(found, fit(found, precision))
    of_kind = lambda name: F.size(F.filter("base_spans", lambda s: s["kind_name"] == name)).cast("long")
    counts = [of_kind(name).alias(f"n_{name}") for name in KINDS]
    return found.select("_row.doc_id", *counts, F.sha2(span_list(F.col("base_spans")), 256).alias("base_sha256"),
                        span_list(F.col("spans")).alias("spans"))
