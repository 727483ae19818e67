r"""Personal data: generated candidates, gradient-boosted trees, calibrated thresholds.

Base rules find e-mail addresses, IP addresses, payment cards and phone numbers; their spans are
always kept.  Beside them, high-recall generators propose overlapping spans (numbers that the base
rules join to a neighbour or do not know, secrets, account and identity numbers, spelled-out
addresses).  Boosted trees score every proposal by its format and its context; a kind's threshold
is the smallest score that reaches ``PRECISION`` on examples the trees have not seen.  Proposals
over their threshold are added unless they overlap a base span; of overlapping ones the best stays,
then the best of those that overlap none that stays, and so on.

The trees are fitted on at most ``TRAIN_TEXTS`` texts of the corpus (the smallest by a seeded hash):
pieces of them carry planted examples of each format of ``FORMATS``, half of them look-alikes.
Everything else runs over all texts.  All of it is DataFrame and SQL functions and the DataFrame
estimator; the patterns use possessive repetition, so long runs neither overflow nor backtrack.

Defined results: null and empty texts have no spans; repeated rows are searched one by one; null
doc_ids are kept; an empty table gives an empty result (no trees are fitted); without training
texts no span is added; further columns are ignored by :func:`find` and kept by :func:`redact`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankfold.llm import textops as X
from rankfold.session import materialize

#: bound of the training sample, in texts
TRAIN_TEXTS = 200
#: characters of a text around a planted example
CARRIER = 120
PRECISION = 0.97
LEFT, RIGHT = 40, 12
SEED = 7

KINDS = ("email", "ip", "card", "phone", "secret", "id", "account")

# The base patterns.  \G and the look-behind only skip starts that the
# leftmost match has already tried.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


@dataclass(frozen=True)
class Generator:
    name: str
    kind: str
    pattern: str


GENERATORS = (
    Generator("email_loose", "email", r"(?:\G|(?<![^\s@<>()\"',;:]))[^\s@<>()\"',;:]++@[^\s@<>()\"',;:]{3,}+"),
    Generator("email_spelled", "email", r"(?:\G|(?<![A-Za-z0-9._-]))[A-Za-z0-9._-]++(?: at | ?\(at\) ?| ?\[at\] ?)[A-Za-z0-9-]++(?: dot | ?\(dot\) ?| ?\[dot\] ?)[A-Za-z]{2,}+"),
    Generator("card_run", "card", r"(?<![0-9])[0-9]{13,19}+(?![0-9])"),
    Generator("card_groups", "card", r"(?<![0-9])[0-9]{4}(?:[\x20-][0-9]{4}){3}(?![0-9])"),
    Generator("phone_code", "phone", r"\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[\x20.-]?[0-9]{2,4}){1,4}(?![0-9])"),
    Generator("phone_ten", "phone", r"\+1[\x20.-]?\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])"),
    Generator("phone_local", "phone", r"(?<![0-9+(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])"),
    Generator("secret_assigned", "secret", r"(?<=(?:password|passwd|pwd|token|secret|api_key|api-key|apikey|access_key|access-key)[\"']?\x20?[=:]\x20?[\"']?)[A-Za-z0-9+/_.-]{8,}+"),
    Generator("secret_upper", "secret", r"(?<![A-Za-z0-9_])[A-Z]{4}[A-Z0-9]{16}(?![A-Za-z0-9_])"),
    Generator("secret_hex", "secret", r"(?<![A-Za-z0-9])[0-9a-f]{32,}+(?![A-Za-z0-9])"),
    Generator("id_number", "id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    Generator("account", "account", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
)
#: a text without any of these has neither base spans nor proposals
TRIGGER = r"[0-9@]|[\x20(\[]dot[\x20)\]]|[A-Z]{20}|[a-f]{32}|(?i:password|passwd|pwd|token|secret|key)"

# Planted examples as (kind or None, template) parts.  # digit, ~ hex digit,
# ^ capital or digit, * lower-case letter, % Luhn check digit of the digits before it, ! a wrong one.
FORMATS: tuple[tuple[tuple[str | None, str], ...], ...] = (
    (("phone", "+1 (###) ###-####"), (None, " "), ("card", "4##############%")),
    (("phone", "+1 (###) ###-####"), (None, " 20##")),
    (("card", "4##############%"), (None, " "), ("card", "5##############%")),
    (("card", "4### #### #### ###%"), (None, " 12 "),),
    ((None, "12345 "), ("card", "4### #### #### ###%")),
    (("phone", "+44 20 7### ####"), (None, " 12345678901234")),
    ((None, "call "), ("phone", "(###) ###-####")),
    ((None, "tel. "), ("phone", "###-###-####")),
    ((None, "phone: "), ("phone", "###.###.####")),
    ((None, "password="), ("secret", "~~~~~~~~~~~~~~~~~~")),
    ((None, "password: "), ("secret", "**##**^^##*")),
    ((None, 'token = "'), ("secret", "~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~"), (None, '"')),
    ((None, 'api_key = "'), ("secret", "^^^^^^^^^^^^^^^^^^^^^^^^"), (None, '"')),
    (("secret", "AKIA^^^^^^^^^^^^^^^^"),),
    ((None, "SSN "), ("id", "###-##-####")),
    ((None, "account "), ("account", "DE## #### #### #### #### ##")),
    (("account", "GB##^^^^##############"),),
    ((None, "mail "), ("email", "****.****** at ****** dot com")),
    (("email", "**** [at] ****** [dot] org"),),
    # look-alikes
    ((None, "4##############!"),),
    ((None, "order no. 9##############!"),),
    ((None, "#### #### #### ####!"),),
    ((None, "isbn 978##########"),),
    ((None, "serial ################!"),),
    ((None, "part ###-###-####"),),
    ((None, "pages ###-###-#### of the index"),),
    ((None, "20##-0#-1# 1#:##:##"),),
    ((None, "version ##.##.####"),),
    ((None, "lot ###-##-####"),),
    ((None, "sha256 ~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~"),),
    ((None, "commit ~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~"),),
    ((None, "md5: ~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~"),),
    ((None, "token: word"),),
    ((None, "secret: none.of.your.business"),),
    ((None, "THE PASSWORD: required"),),
    ((None, "SHOUTINGLOUDLYALLDAY"),),
    ((None, "CHAPTERTWENTYSECONDS"),),
    ((None, "we met at noon dot matrix"),),
    ((None, "user@localhost"),),
    ((None, "@handle and a@b"),),
    ((None, "+1 #"),),
    ((None, "+####"),),
    ((None, "FR20 ABLE BAKE CAKE DARE"),),
    # long secrets and a long look-alike
    ((None, "token="), ("secret", ("^*#*" * 9 + ".") * 4 + "^*#*" * 4)),
    ((None, "token="), ("secret", "ey" + "*^*^*^^*" * 5 + "." + "*^*_*^^*" * 8 + "." + "^*^*-**^" * 6)),
    ((None, "secret_key: "), ("secret", "~" * 128)),
    ((None, "sha512 " + "~" * 128),),
)

_FEATURES = (
    "n_chars", "n_digits", "n_lower", "n_upper", "n_other", "n_groups", "longest_group", "n_kinds", "luhn", "hex", "digit_share",
    "cue_secret", "cue_phone", "cue_id", "cue_number", "cue_digest", "assigned", "before_space", "after_space", "after_digit", "dotted",
)
_CUES = {
    # fixed values: words before a span that speak for or against a kind
    "cue_secret": r"(?i)(?:password|passwd|pwd|token|secret|api.?key|access.?key)\W{0,4}$",
    "cue_phone": r"(?i)(?:phone|tel|call|mobile|fax)\W{0,4}$",
    "cue_id": r"(?i)(?:ssn|social|passport|account|iban|bank)\W{0,4}$",
    "cue_number": r"(?i)(?:order|no|serial|part|pages?|lot|isbn|version|item)\W{0,4}$",
    "cue_digest": r"(?i)(?:sha ?\d*|md5|commit|hash|checksum|digest)\W{0,4}$",
    "assigned": r"[=:][\x20\"']*$",
}


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a string of digits, the last one counted once."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((2 * c.cast("int")) % 10 + F.floor(2 * c.cast("int") / 10).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]+", "")


def base_valid(kind: Column, s: Column) -> Column:
    n = F.length(_digits(s))
    parts_ok = F.forall(F.split(s, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.right(p, F.lit(3)).cast("int"), F.lit(0)) <= 255))
    return (
        F.when(kind == "email", F.lit(True)).when(kind == "ip", parts_ok)
        .when(kind == "card", F.when(n.between(14, 19), luhn_sum(_digits(s)) % 10 == 0).otherwise(F.lit(False)))
        .otherwise(n.between(10, 15))
    )


def matches(rows: DataFrame, patterns: dict[str, str], text: str = "text") -> DataFrame:
    """(row, gen, start, end, s, left, right): the leftmost non-overlapping matches of each pattern,
    in code points.  A match starts after the pieces and matches before it; sums run in windows."""
    names = list(patterns)
    others = [c for c in rows.columns if c != text]
    cut = rows.select(
        *others,
        *[F.split(F.col(text), p, -1).alias(f"_p{i}") for i, p in enumerate(patterns.values())],
        *[F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0)).alias(f"_m{i}") for i, p in enumerate(patterns.values())],
    )

    def found(i: int) -> Column:
        pieces = F.col(f"_p{i}")
        return F.transform(
            F.col(f"_m{i}"),
            lambda m, k: F.struct(
                F.lit(names[i]).alias("gen"), k.alias("k"), F.length(F.get(pieces, k)).alias("gap"), m.alias("s"),
                F.right(F.get(pieces, k), F.lit(LEFT)).alias("left"), F.substring(F.get(pieces, k + 1), 1, RIGHT).alias("right"),
            ),
        )

    each = cut.select(*others, F.explode(F.flatten(F.array(*[found(i) for i in range(len(names))]))).alias("m")).select(*others, "m.*")
    upto = Window.partitionBy("row", "gen").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.length("s")).over(upto).cast("bigint")
    return each.withColumn("end", end).withColumn("start", F.col("end") - F.length("s")).drop("gap", "k")


def with_features(found: DataFrame) -> DataFrame:
    s, left, right = F.col("s"), F.col("left"), F.col("right")
    digits = _digits(s)
    groups = F.filter(F.split(s, "[^0-9]+"), lambda g: g != "")
    number = {
        "n_chars": F.length(s), "n_digits": F.length(digits), "n_lower": F.length(F.regexp_replace(s, "[^a-z]+", "")),
        "n_upper": F.length(F.regexp_replace(s, "[^A-Z]+", "")), "n_other": F.length(F.regexp_replace(s, "[A-Za-z0-9]+", "")),
        "n_groups": F.size(groups), "longest_group": F.coalesce(F.array_max(F.transform(groups, lambda g: F.length(g))), F.lit(0)),
        "n_kinds": F.size(F.array_distinct(F.split(s, ""))),
        "luhn": F.when(F.length(digits).between(13, 19), luhn_sum(digits) % 10 == 0).otherwise(F.lit(False)),
        "hex": s.rlike("^[0-9a-f]+$"), "digit_share": F.length(digits) / F.length(s),
        **{name: left.rlike(p) for name, p in _CUES.items()},
        "before_space": left.rlike(r"(?:^|\s)$"), "after_space": right.rlike(r"^(?:\s|$)"), "after_digit": right.rlike(r"^[\x20-]?[0-9]"),
        "dotted": s.rlike(r"\.[A-Za-z]{2,}$"),
    }
    names = [g.name for g in GENERATORS]
    return found.select(
        "*", *[number[n].cast("double").alias(n) for n in _FEATURES], *[(F.col("gen") == n).cast("double").alias(f"is_{n}") for n in names],
    )


def _fill(template: Column, key: Column) -> Column:
    def pick(letters: str, i: Column) -> Column:
        return F.substring(F.lit(letters), (F.pmod(F.xxhash64(key, i), F.lit(len(letters))) + 1).cast("int"), F.lit(1))

    def one(c: Column, i: Column) -> Column:
        return (
            F.when(c == "#", pick("0123456789", i)).when(c == "~", pick("0123456789abcdef", i))
            .when(c == "^", pick("ABCDEFGHJKMNPQRSTVWXYZ23456789", i)).when(c == "*", pick("abcdefghijklmnopqrstuvwxyz", i)).otherwise(c)
        )

    text = F.array_join(F.transform(F.filter(F.split(template, ""), lambda c: c != ""), one), "")
    check = F.pmod(10 - luhn_sum(F.concat(_digits(text), F.lit("0"))) % 10, F.lit(10))
    wrong = (check + 1 + F.pmod(F.xxhash64(key), F.lit(9)).cast("int")) % 10
    return (
        F.when(template.contains("%"), F.replace(text, F.lit("%"), check.cast("string")))
        .when(template.contains("!"), F.replace(text, F.lit("!"), wrong.cast("string"))).otherwise(text)
    )


def training_candidates(texts: DataFrame, seed: int = SEED) -> DataFrame:
    """Proposals in planted texts with ``label`` 1 where a planted example stands, and ``part`` 0..2."""
    sample = (
        texts.where(F.length("text") > 2 * CARRIER).select("text", F.xxhash64(F.lit(seed), "text").alias("h"))
        .orderBy("h").limit(TRAIN_TEXTS).dropDuplicates(["h"])
    )
    formats = F.array(*[
        F.array(*[F.struct(F.lit(kind).cast("string").alias("kind"), F.lit(t).alias("t")) for kind, t in parts]) for parts in FORMATS
    ])
    planted = sample.select("h", "text", F.posexplode(formats).alias("format", "parts")).repartition("h", "format")
    at = (F.pmod(F.xxhash64("h", "format"), F.length("text") - 2 * CARRIER) + 1).cast("int")
    filled = planted.select(
        F.xxhash64("h", "format").alias("row"), F.col("h"),
        F.concat(F.regexp_replace(F.substring(F.col("text"), at, F.lit(CARRIER)), "[0-9@+]", ""), F.lit(" ")).alias("before"),
        F.concat(F.lit(" "), F.regexp_replace(F.substring(F.col("text"), at + CARRIER, F.lit(CARRIER)), "[0-9@+]", "")).alias("after"),
        F.transform("parts", lambda p, i: F.struct(p["kind"].alias("kind"), _fill(p["t"], F.xxhash64("h", "format", i)).alias("t"))).alias("parts"),
    )
    spans = F.transform(
        "parts",
        lambda p, i: F.struct(
            p["kind"].alias("kind"),
            (F.length("before") + F.aggregate(F.slice("parts", F.lit(1), i), F.lit(0), lambda a, q: a + F.length(q["t"]))).alias("start"),
            F.length(p["t"]).alias("n"),
        ),
    )
    rows = materialize(
        filled.select("row", "h", F.concat("before", F.array_join(F.transform("parts", lambda p: p["t"]), ""), "after").alias("text"), spans.alias("truth")), "planted"
    )
    found = matches(rows, {g.name: g.pattern for g in GENERATORS})
    kind = _kind_of(F.col("gen"))
    label = F.exists("truth", lambda t: (t["kind"] == kind) & (t["start"] == F.col("start")) & (t["n"] == F.col("end") - F.col("start")))
    return with_features(found).withColumn("kind", kind).withColumn("label", F.coalesce(label, F.lit(False)).cast("double")).withColumn("part", F.pmod("h", F.lit(3)))


def _kind_of(gen: Column) -> Column:
    out = F.lit(None).cast("string")
    for g in GENERATORS:
        out = F.when(gen == g.name, g.kind).otherwise(out)
    return out


_INPUTS = [*_FEATURES, *(f"is_{g.name}" for g in GENERATORS)]


def fit(texts: DataFrame, seed: int = SEED, rounds: int = 12, depth: int = 4):
    """(trees, threshold of each kind), or None without training texts.  Two thirds of the sampled
    texts fit the trees; the rest choose the thresholds."""
    rows = materialize(VectorAssembler(inputCols=_INPUTS, outputCol="features").transform(training_candidates(texts, seed)).select("features", "label", "kind", "part").coalesce(1), "candidates")
    classes = rows.where("part < 2").agg(F.min("label"), F.max("label")).first()
    if classes[0] != 0.0 or classes[1] != 1.0:
        return None
    trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=rounds, maxDepth=depth, seed=seed, stepSize=0.3).fit(rows.where("part < 2"))
    scored = trees.transform(rows.where("part = 2")).select("kind", "label", F.round(vector_to_array("probability")[1], 2).alias("p"))
    above = Window.partitionBy("kind").orderBy(F.desc("p"))
    curve = scored.groupBy("kind", "p").agg(F.sum("label").alias("good"), F.count(F.lit(1)).alias("n")).withColumn(
        "precision", F.sum("good").over(above) / F.sum("n").over(above)
    )
    # the smallest score from which on all larger ones keep the precision
    worst = curve.withColumn("worst", F.min("precision").over(above)).where(F.col("worst") >= PRECISION)
    found = worst.groupBy("kind").agg(F.min("p").alias("p")).collect()  # one row for each kind
    return trees, {r["kind"]: max(float(r["p"]), 0.5) for r in found}


def best_apart(spans: DataFrame) -> DataFrame:
    """Spans (row, kind, start, end, p) that overlap no better one that stays, best first in each chain
    of overlapping spans."""
    order = Window.partitionBy("row").orderBy("start", "end", "kind")
    past = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    chained = spans.withColumn("_new", F.coalesce(F.col("start") >= past, F.lit(True)).cast("int")).withColumn("_chain", F.sum("_new").over(order))
    each = F.struct((-F.col("p")).alias("worse"), (F.col("start") - F.col("end")).alias("shorter"), "start", "kind", "end", "p")
    chains = chained.groupBy("row", "_chain").agg(F.sort_array(F.collect_list(each)).alias("_c"))
    taken = F.aggregate(
        "_c", F.filter("_c", lambda s: F.lit(False)),
        lambda a, s: F.when(F.exists(a, lambda t: (t["start"] < s["end"]) & (s["start"] < t["end"])), a).otherwise(F.concat(a, F.array(s))),
    )
    return chains.select("row", F.explode(taken).alias("s")).select("row", "s.kind", "s.start", "s.end", "s.p")


def find(docs: DataFrame, model=None, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): rows has (row, doc_id) for each row of ``docs``; spans has (row, kind, rank,
    start, end, base) in code points, end exclusive.  Without ``model`` the trees are fitted here."""
    texts = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    hit = F.coalesce(F.col("text"), F.lit("")).rlike(TRIGGER)
    rows = materialize(
        texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.when(hit, F.col("text")).alias("text")), "texts", compression="zstd"
    )
    searched = rows.where("text IS NOT NULL").select("row", "text")
    found = materialize(matches(searched, BASE | {g.name: g.pattern for g in GENERATORS}), "matches")
    is_base = F.col("gen").isin(list(BASE))
    base = found.where(is_base & base_valid(F.col("gen"), F.col("s"))).select("row", F.col("gen").alias("kind"), "start", "end", F.lit(2.0).alias("p"))
    if model is None and not rows.isEmpty():
        model = fit(texts.where("text IS NOT NULL"), seed)
    spans = base
    if model is not None:
        trees, thresholds = model
        proposed = VectorAssembler(inputCols=_INPUTS, outputCol="features").transform(with_features(found.where(~is_base)).withColumn("kind", _kind_of(F.col("gen"))))
        scored = trees.transform(proposed).select("row", "kind", "start", "end", vector_to_array("probability")[1].alias("p"))
        limit = F.lit(2.0)
        for kind, p in thresholds.items():
            limit = F.when(F.col("kind") == kind, F.lit(p)).otherwise(limit)
        spans = base.unionByName(scored.where(F.round("p", 2) >= limit).groupBy("row", "kind", "start", "end").agg(F.max("p").alias("p")))
        # overlaps with base spans: one that began earlier and reaches in, or one that begins inside
        by_start = Window.partitionBy("row").orderBy("start")
        reach = F.max(F.when(F.col("p") == 2.0, F.col("end"))).over(by_start)
        begins = F.min(F.when(F.col("p") == 2.0, F.col("start"))).over(by_start.rangeBetween(Window.currentRow, Window.unboundedFollowing))
        free = spans.withColumn("_reach", reach).withColumn("_begins", begins).where(
            (F.col("p") == 2.0) | ((F.coalesce("_reach", F.lit(0)) <= F.col("start")) & F.coalesce(F.col("_begins") >= F.col("end"), F.lit(True)))
        ).drop("_reach", "_begins")
        # base spans of different kinds may overlap and stay
        spans = base.unionByName(best_apart(free.where("p < 2.0")))
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    return rows.select("row", "doc_id"), materialize(spans.select("row", "kind", rank.alias("rank"), "start", "end", (F.col("p") == 2.0).alias("base")), "spans")


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans), one row per row of ``docs``."""
    rows, spans = find(docs)
    written = F.struct("start", "rank", F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string")).alias("t"))
    by_row = spans.groupBy("row").agg(
        *[F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in BASE],
        F.sort_array(F.collect_list(F.when(F.col("base"), written))).alias("b"), F.sort_array(F.collect_list(written)).alias("a"),
    )
    none = F.array().cast("array<string>")
    return rows.join(by_row, "row", "left").select(
        "doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("bigint").alias(f"n_{k}") for k in BASE],
        F.sha2(F.array_join(F.coalesce("b.t", none), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.coalesce("a.t", none), ",").alias("spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every found span replaced by its kind in brackets; overlapping spans are
    replaced together by the first one's kind.  Other columns are kept."""
    row, cut_row, cuts_of = (X.free_name(docs.columns, n) for n in ("_row", "_cut_row", "_cuts"))
    keyed = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "documents")
    rows, spans = find(keyed.select(F.col(row).alias("doc_id"), "text"))
    order = Window.partitionBy("row").orderBy("start", "rank")
    past = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    joined = spans.withColumn("_new", F.coalesce(F.col("start") >= past, F.lit(True)).cast("int")).withColumn("_group", F.sum("_new").over(order))
    merged = joined.groupBy("row", "_group").agg(F.min(F.struct("start", "rank", "kind")).alias("first"), F.max("end").alias("end"))
    cuts = (
        merged.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("first.start", "end", "first.kind"))).alias(cuts_of))
        .join(rows, "row").select(F.col("doc_id").alias(cut_row), cuts_of)
    )
    end_of = lambda i: F.coalesce(F.get(F.col(cuts_of), i)["end"], F.lit(0))
    pieces = F.transform(
        cuts_of,
        lambda c, i: F.concat(
            F.substring(F.col("text"), (end_of(i - 1) + 1).cast("int"), (c["start"] - end_of(i - 1)).cast("int")), F.lit("["), c["kind"], F.lit("]"),
        ),
    )
    tail = F.substring(F.col("text"), (F.element_at(cuts_of, -1)["end"] + 1).cast("int"), F.length("text"))
    text = F.when(F.col(cuts_of).isNotNull(), F.concat(F.array_join(pieces, ""), tail)).otherwise(F.col("text"))
    joined = keyed.join(cuts, F.col(row) == F.col(cut_row), "left")
    return joined.withColumn("text", text).select(*[F.col(f"`{c}`") for c in docs.columns])
