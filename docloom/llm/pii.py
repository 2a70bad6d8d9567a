"""Personal data by candidate gradient boosting.

Fixed patterns find the plain forms. Beyond these, generators of high recall propose spans, which may overlap; boosted trees judge each by its
format and the words before it; and of those over their kind's threshold, calibrated for precision on examples that the trees
have not seen, the best of overlapping ones are added. The trees are Spark's, learned from formats that are spelt out below, and
are applied as column expressions, within the row of the document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import scratch

# The plain forms. Runs are possessive and begin at their first character (or where the last match ended), which
# finds the same leftmost matches in linear time.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

# What the generators propose, by kind.
GENERATORS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]{1,64}+\x20?[\[(](?:at|AT|@)[\])]\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\.|[\[(](?:dot|DOT|\.)[\])])\x20?[A-Za-z0-9-]{1,63}+){1,4}",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{4}(?:[\x20./-]?[0-9]{2,6}){2,4}(?![0-9])",
    "phone": r"(?<![0-9])(?:00[0-9]{1,3}[\x20.-]?)?\(?0?[0-9]{2,4}\)?[\x20./-][0-9]{3,4}[\x20./-]?[0-9]{3,4}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/-]{16,}+={0,2}(?![A-Za-z0-9_+/=-])",
}
KINDS = ["email", "ip", "card", "phone", "secret"]
# Words that speak for a kind when they stand before a span.
CONTEXT = {
    "email": r"mail|contact|write|correo|courriel",
    "ip": r"\bip\b|address|host|server|addr",
    "card": r"card|visa|iban|account|konto|carte|tarjeta|pay",
    "phone": r"phone|tel|call|mobile|fax|cell|contact|t[eé]l[eé]|tel[eé]fono|anruf",
    "secret": r"token|key|secret|passw|pwd|credential|bearer|auth",
}
BEFORE = 24
PRECISION, EXAMPLES, TREES, DEPTH = 0.98, 6000, 12, 4
#: Formats of labelled_examples.
CASES = 29


#: Matches of a text whose places are worked out together, so that time grows with their number and not with its square.
TOGETHER = 64


def _found(text: Column, pattern: str) -> Column:
    """array of (start, end, match): leftmost non-overlapping matches; code points, end exclusive."""
    matches, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    none = F.array().cast("array<struct<start:int,end:int,match:string>>")
    # One gap more than matches: the text after the last one.
    pairs = F.filter(F.zip_with(matches, between, lambda m, g: F.struct(m.alias("match"), F.length(g).alias("gap"))), lambda p: p["match"].isNotNull())
    size = lambda p: p["gap"] + F.length(p["match"])

    def step(acc: Column, pair: Column) -> Column:
        a = acc["at"] + pair["gap"]
        b = a + F.length(pair["match"])
        return F.struct(b.alias("at"), F.concat(acc["spans"], F.array(F.struct(a.alias("start"), b.alias("end"), pair["match"].alias("match")))).alias("spans"))

    def placed(some: Column, at: Column) -> Column:
        return F.aggregate(some, F.struct(at.alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])

    def in_runs(pairs: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / TOGETHER).cast("int")), lambda i: F.slice(pairs, i * TOGETHER + 1, F.lit(TOGETHER)))
        totals = F.transform(runs, lambda r: F.aggregate(r, F.lit(0), lambda a, p: a + size(p)))
        starts = F.aggregate(totals, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
        return F.flatten(F.zip_with(runs, F.slice(starts, F.lit(1), F.size(runs)), placed))

    # A variable of its own, so that the pairs are made once.
    return F.flatten(F.transform(F.array(pairs), lambda p: F.when(F.size(p) > TOGETHER, in_runs(p)).otherwise(placed(p, F.lit(0)))))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit fits; false for no digits."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda d: d.cast("int"))
    doubled = F.transform(values, lambda d, i: F.when(i % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d))
    return (digits != "") & (F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0)


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.right(p, F.lit(3)).cast("int") <= 255))
    if kind == "card":
        return F.length(_digits(match)).between(16, 19) & luhn(_digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column) -> dict[str, Column]:
    """array of (start, end, match) by kind. Texts without the characters that a kind needs are not searched for it."""
    needs = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]"), "phone": text.contains("+")}
    none = F.array().cast("array<struct<start:int,end:int,match:string>>")

    def of(kind: str, pattern: str) -> Column:
        return F.when(needs[kind], F.filter(_found(text, pattern), lambda x: _valid(kind, x["match"]))).otherwise(none)

    return {kind: of(kind, pattern) for kind, pattern in (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE))}


def features(kind: Column, match: Column, before: Column) -> list[Column]:
    """Of format and context, each a number."""
    digits, low = _digits(match), F.lower(before)
    number = lambda x: x.cast("double")
    length = F.greatest(F.length(match), F.lit(1))
    groups = F.filter(F.split(match, "[^0-9A-Za-z]+"), lambda g: g != "")
    return [
        *(number(kind == k) for k in KINDS),
        *(number(low.rlike(CONTEXT[k])) for k in KINDS),
        number(low.rlike(r"[=:]\s*[\"']?$")),
        number(F.length(match)),
        number(F.length(digits)),
        number(F.length(digits)) / length,
        number(F.length(F.regexp_replace(match, "[^A-Z]", ""))) / length,
        number(F.size(F.array_distinct(F.split(match, "")))) / length,
        number(F.size(groups)),
        number(F.size(F.array_distinct(F.transform(groups, lambda g: F.length(g))))),
        number(luhn(digits)),
        number(match.rlike("^[0-9A-Fa-f]+$")),
        number(match.rlike(r"^(?:19|20)[0-9]{2}(?:[^0-9]|$)")),
        number(F.regexp_count(match, F.lit("(?<=[a-z])[0-9]|(?<=[0-9])[a-zA-Z]"))) / length,
        number(F.regexp_count(match, F.lit(r"[./_]"))),
    ]


def labelled_examples(spark: SparkSession, n: int = EXAMPLES) -> DataFrame:
    """(kind, match, before, label): n examples of formats with digits and letters drawn by a hash, half of them personal data."""
    draw = lambda salt, m: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(m))
    hexes = F.sha2(F.col("id").cast("string"), 256)
    numbers = F.regexp_replace(F.concat(F.abs(F.xxhash64("id", F.lit(1))).cast("string"), F.abs(F.xxhash64("id", F.lit(2))).cast("string")), "^0+", "7")
    name = F.concat(F.translate(F.substring(hexes, 1, 6), "0123456789", "ghijklmnop"), F.lit("."), F.translate(F.substring(hexes, 8, 5), "0123456789", "qrstuvwxyz"))
    part = lambda a, k: F.substring(numbers, a, k)
    mixed_case = F.translate(F.regexp_replace(F.base64(F.unhex(hexes)), "[=\n\r]", ""), "", "")
    first = F.concat(F.element_at(F.array(*map(F.lit, "3456")), (draw(3, 4) + 1).cast("int")), part(1, 14))
    # The last digit that makes a card number right.
    values = F.transform(F.split(F.reverse(first), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int")))
    check = F.pmod(-F.aggregate(values, F.lit(0), lambda a, d: a + d), F.lit(10)).cast("string")
    right, wrong = F.concat(first, check), F.concat(first, F.pmod(check.cast("int") + 1 + draw(5, 8), F.lit(10)).cast("int").cast("string"))
    four = lambda x, s: F.concat_ws(s, *(F.substring(x, 1 + 4 * i, 4) for i in range(4)))
    words = lambda *w: F.element_at(F.array(*map(F.lit, w)), (draw(7, len(w)) + 1).cast("int"))
    day = F.lpad((draw(8, 28) + 1).cast("string"), 2, "0")
    month = F.lpad((draw(9, 12) + 1).cast("string"), 2, "0")
    year = (F.lit(1990) + draw(10, 36)).cast("string")
    # Long forms: 6 to 45 hashes in a row.
    several = F.transform(F.sequence(F.lit(0), 5 + draw(11, 40).cast("int")), lambda i: F.sha2(F.concat_ws(".", F.col("id").cast("string"), i.cast("string")), 256))
    long_hexes = F.array_join(several, "")
    long_mixed = F.regexp_replace(F.base64(F.unhex(long_hexes)), "[=\n\r]", "")
    long_letters = F.translate(long_hexes, "0123456789", "ghijklmnop")
    cases = [
        ("email", F.concat(name, words(" [at] ", "(at)", "[at]", " (at) "), F.substring(hexes, 20, 6), words(".com", " [dot] org", "(dot)net", "[dot]de")), words("mail ", "contact: ", "write to ", "the of "), 1),
        ("email", F.concat(part(1, 2), F.lit(" (at) "), part(4, 2), F.lit("."), part(7, 2)), words("score ", "rated ", "sold ", "of "), 0),
        ("ip", F.concat_ws(":", *(F.substring(hexes, 1 + 4 * i, 4) for i in range(8))), words("host ", "address ", "from ", "server "), 1),
        ("ip", F.concat_ws(":", part(1, 2), part(3, 2), part(5, 2), part(7, 2)), words("time ", "at ", "ratio ", "after "), 0),
        ("card", four(right, " "), words("card ", "visa: ", "pay ", "the number "), 1),
        ("card", four(right, "."), words("card ", "carte ", "tarjeta ", "konto "), 1),
        ("card", four(wrong, " "), words("order ", "row ", "total ", "table "), 0),
        ("card", F.concat(part(1, 4), F.lit("."), part(5, 4), F.lit("."), part(9, 4)), words("section ", "version ", "part no ", "see "), 0),
        ("card", F.concat(year, month, day, part(1, 6)), words("dated ", "log ", "file ", "build "), 0),
        ("phone", F.concat(F.lit("("), part(1, 3), F.lit(") "), part(4, 3), F.lit("-"), part(7, 4)), words("call ", "phone: ", "tel ", "mobile "), 1),
        ("phone", F.concat(part(1, 3), F.lit("-"), part(4, 3), F.lit("-"), part(7, 4)), words("call ", "phone: ", "fax ", "contact "), 1),
        ("phone", F.concat(F.lit("0049 "), part(1, 3), F.lit(" "), part(4, 4), part(8, 3)), words("tel. ", "anruf ", "telefon ", "call "), 1),
        ("phone", F.concat(year, F.lit("-"), part(1, 4), F.lit("-"), part(5, 4)), words("issue ", "volume ", "of ", "page "), 0),
        ("phone", F.concat(part(1, 3), F.lit("."), part(4, 3), F.lit("."), part(7, 3)), words("sum ", "costs ", "of ", "about "), 0),
        ("phone", F.concat(part(1, 4), F.lit("/"), part(5, 4), part(9, 3)), words("ref ", "no. ", "row ", "in "), 0),
        ("secret", F.substring(hexes, 1, 40), words('token = "', "key: ", "secret=", "password = '"), 1),
        ("secret", mixed_case, words("api_key = ", "bearer ", "token: ", "credentials "), 1),
        ("secret", F.concat(F.lit("sk_live_"), F.substring(mixed_case, 1, 24)), words("use ", "with ", "key ", "set "), 1),
        ("secret", F.translate(F.substring(hexes, 1, 24), "0123456789", "ghijklmnop"), words("the ", "a ", "of ", "word "), 0),
        ("secret", F.concat(F.lit("https-path/"), F.translate(F.substring(hexes, 1, 8), "0123456789", "ghijklmnop"), F.lit("/"), F.translate(F.substring(hexes, 9, 9), "0123456789", "ghijklmnop")), words("see ", "at ", "url ", "from "), 0),
        ("secret", F.substring(hexes, 1, 32), words("checksum ", "digest ", "commit ", "etag "), 0),
        ("secret", F.concat(F.lit("figure-"), year, F.lit("-"), month, F.lit("-overview")), words("see ", "in ", "the ", "file "), 0),
        ("secret", long_hexes, words('token = "', "key: ", "secret=", "password = '"), 1),
        ("secret", long_mixed, words("api_key = ", "bearer ", "token: ", "credentials "), 1),
        ("secret", F.concat(F.lit("eyJ"), long_mixed), words("auth ", "jwt ", "session ", "with "), 1),
        ("secret", F.repeat(words("a", "x", "-", "_"), F.length(long_hexes)), words("", "the ", "line ", "key "), 0),
        ("secret", F.repeat(part(1, 1), F.length(long_hexes)), words("", "of ", "row ", "sum "), 0),
        ("secret", F.regexp_replace(long_letters, "(.{7})", "$1/"), words("see ", "at ", "path ", "from "), 0),
        ("secret", long_letters, words("", "the ", "sequence ", "word "), 0),
    ]
    assert len(cases) == CASES
    made = F.array(*(F.struct(F.lit(k).alias("kind"), m.alias("match"), b.alias("before"), F.lit(float(y)).alias("label")) for k, m, b, y in cases))
    rows = spark.range(n).select("id", F.element_at(made, (F.col("id") % len(cases) + 1).cast("int")).alias("x"))
    return rows.select("id", "x.*")


def _tree(node) -> float | tuple:
    """A regression tree of Spark's as (feature, threshold, left, right) or a prediction."""
    if node.subtreeDepth() == 0:
        return float(node.prediction())
    split = node.split()
    return split.featureIndex(), float(split.threshold()), _tree(node.leftChild()), _tree(node.rightChild())


def _as_column(tree: float | tuple, at: Callable[[int], Column]) -> Column:
    """A tree as nested conditions."""
    if isinstance(tree, float):
        return F.lit(tree)
    feature, threshold, left, right = tree
    return F.when(at(feature) <= threshold, _as_column(left, at)).otherwise(_as_column(right, at))


class Judge:
    """The boosted trees and each kind's threshold."""

    def __init__(self, spark: SparkSession, n: int = EXAMPLES, precision: float = PRECISION):
        examples = labelled_examples(spark, n).coalesce(1).withColumn("f", F.array(*features(F.col("kind"), F.col("match"), F.col("before"))))
        size = len(features(F.lit(""), F.lit(""), F.lit("")))
        rows = examples.select("kind", "label", ((F.col("id") / CASES).cast("long") % 4 == 0).alias("calibrate"), *(F.col("f")[i].alias(f"f{i}") for i in range(size)))
        with scratch(spark, "judge") as work:
            self._fit(work(rows, "examples"), size, precision)

    def _fit(self, rows: DataFrame, size: int, precision: float) -> None:
        """rows are read once a tree and level, so they are a table by now."""
        vectors = VectorAssembler(inputCols=[f"f{i}" for i in range(size)], outputCol="features").transform(rows.where("NOT calibrate"))
        model = GBTClassifier(labelCol="label", featuresCol="features", maxIter=TREES, maxDepth=DEPTH, seed=1).fit(vectors)
        self.trees = [(float(w), _tree(t._java_obj.rootNode())) for w, t in zip(model.treeWeights, model.trees)]
        # The lowest score from which on the examples reach the precision.
        scored = rows.where("calibrate").select("kind", "label", self._score(lambda i: F.col(f"f{i}")).alias("score"))
        down = W.partitionBy("kind").orderBy(F.col("score").desc()).rangeBetween(W.unboundedPreceding, W.currentRow)
        reached = scored.withColumn("precise", F.avg("label").over(down)).where(F.col("precise") >= precision)
        lowest = {r["kind"]: float(r["score"]) for r in reached.groupBy("kind").agg(F.min("score").alias("score")).collect()}
        self.thresholds = {k: max(0.5, lowest.get(k, 2.0)) for k in KINDS}

    def _score(self, at: Callable[[int], Column]) -> Column:
        margin = F.lit(0.0)
        for weight, tree in self.trees:
            margin = margin + weight * _as_column(tree, at)
        return 1 / (1 + F.exp(-2 * margin))

    def score(self, f: Column) -> Column:
        return self._score(lambda i: f[i])


_JUDGES: dict[tuple, Judge] = {}


def fitted_judge(spark: SparkSession, n: int = EXAMPLES, precision: float = PRECISION) -> Judge:
    """The judge of these parameters, fitted once in an application: it is numbers only, and the same each time."""
    key = (spark.sparkContext.applicationId, n, precision)
    if key not in _JUDGES:
        _JUDGES[key] = Judge(spark, n, precision)
    return _JUDGES[key]


def proposed_spans(text: Column, base: Column, judge: Judge) -> Column:
    """array of (kind, start, end, score): proposals over their kind's threshold that overlap no span of base."""
    needs = {"email": text.rlike(r"[\[(](?:at|AT|@)[\])]"), "ip": text.rlike("[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:"), "secret": text.rlike("[A-Za-z0-9_+/-]{16}")}
    none = F.array().cast("array<struct<start:int,end:int,match:string>>")

    def of(kind: str) -> Column:
        found = F.when(needs.get(kind, text.rlike(r"[0-9]{3}")), _found(text, GENERATORS[kind])).otherwise(none)
        free = F.filter(found, lambda x: ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))

        def described(x: Column) -> Column:
            a = F.greatest(x["start"] - BEFORE, F.lit(0))
            f = F.array(*features(F.lit(kind), x["match"], F.substring(text, a + 1, x["start"] - a)))
            return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), f.alias("f"))

        return F.transform(free, described)

    # All kinds are scored by one copy of the trees.
    scored = F.transform(F.concat(*map(of, KINDS)), lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), judge.score(c["f"]).alias("score")))
    limits = F.create_map(*(F.lit(x) for pair in judge.thresholds.items() for x in pair))
    return F.filter(scored, lambda c: c["score"] >= F.element_at(limits, c["kind"]))


def best_spans(spans: Column) -> Column:
    """Taken one after the other, those that overlap none taken before: of highest score first, then first, then longer."""
    order = F.array_sort(F.transform(spans, lambda x: F.struct((-x["score"]).alias("down"), x["start"].alias("start"), (-x["end"]).alias("back"), x["kind"].alias("kind"))))
    none = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")

    def step(kept: Column, x: Column) -> Column:
        overlaps = F.exists(kept, lambda k: (k["start"] < -x["back"]) & (x["start"] < k["end"]))
        span = F.struct(x["kind"].alias("kind"), x["start"].alias("start"), (-x["back"]).alias("end"), (-x["down"]).alias("score"))
        return F.when(overlaps, kept).otherwise(F.concat(kept, F.array(span)))

    return F.aggregate(order, none, step)


def find_pii(docs: DataFrame, judge: Judge, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: doc_id, text, base (plain forms) and spans (all, with score; 1.0 for plain ones): arrays of (kind, start, end, score) by kind, then start.

    Null texts are empty and have no spans; a text of any length is searched whole, in its task. Of proposals that overlap the one of highest
    score is taken, of equal scores the first, then the longer. Rows that repeat an id are searched each; other columns are not read,
    whatever their names; an empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    found = rows.select("doc_id", "text", *(c.alias(k) for k, c in base_spans(F.col("text")).items()))

    def plain(kind: str) -> Column:
        return F.transform(F.col(kind), lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.lit(1.0).alias("score")))

    def of_kind(kind: str) -> Column:
        return F.array_sort(F.filter("spans", lambda x: x["kind"] == kind))

    based = found.select("doc_id", "text", F.concat(*map(plain, KINDS[:4])).alias("base"))
    proposed = based.withColumn("proposed", proposed_spans(F.col("text"), F.col("base"), judge))
    every = proposed.select("doc_id", "text", "base", F.concat("base", best_spans(F.col("proposed"))).alias("spans"))
    return every.select("doc_id", "text", "base", F.concat(*map(of_kind, KINDS)).alias("spans"))


def redact(found: DataFrame) -> DataFrame:
    """doc_id and redacted: the text with every span of find_pii replaced by its kind in brackets; spans that overlap are replaced together."""
    order = F.array_sort(F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.when(x["start"] >= acc["at"], F.concat(F.substring(F.col("text"), acc["at"] + 1, x["start"] - acc["at"]), F.lit("["), x["kind"], F.lit("]"))).otherwise("")
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.concat(acc["out"], gap).alias("out"))

    done = F.aggregate(order, start, step)
    return found.withColumn("done", done).select("doc_id", F.concat("done.out", F.substring(F.col("text"), F.col("done.at") + 1, F.length("text"))).alias("redacted"))


def as_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
