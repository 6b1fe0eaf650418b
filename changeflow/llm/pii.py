r"""Personal data: fixed patterns first, then bootstrapped contextual extraction. DataFrame functions only.

Seeds are the entities that the fixed patterns find. Mentions are the seeds and every other run of digit groups or token
with an at sign; what a mention could be follows from its form alone (`fits`: how many digits, an at sign, four numbers with
dots). Its lexical patterns are the word before it, the word after it, and both, never its own characters. For each kind,
patterns and instances (distinct mentions) form a bipartite graph, in which scores spread in turn: a pattern's confidence is
the mean score of the instances in it that fit the kind; an instance's is the best confidence among its patterns that have
`support` distinct seeds; seeds stay at 1 for their own kind and at 0 for others. After a few rounds, patterns with enough
seeds and a high confidence yield the mentions in them that no fixed pattern found, each as its most confident kind.

Whether that finds anything depends on the corpus: where words say nothing about what stands beside them, no pattern gets
confident and nothing is added. `held_out` measures it, by hiding a part of the seeds and counting those that come back.

The text is read once; spans and mentions of all rows are written to the shared folder, and the rounds work on distinct
(pattern, kind, instance), so copies of a text don't count twice, and a word that precedes a third of all mentions is
aggregated before its shuffle. Confident patterns are broadcast while they are few, else joined by shuffle.

Defined results: null and empty texts have no spans; repeated rows are rows of their own; an empty table gives no rows.
Columns other than the id and the text are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeflow.llm.common import let, match_spans, save, tagged

#: Fixed kinds, in the order that breaks ties between spans with one start.
KINDS = ("email", "ip", "card", "phone")
# Look-behinds and possessive quantifiers only spare attempts that must fail: long runs stay linear, and no group recurses.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_IP_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Runs of digit groups, and tokens with an at sign. Both begin at a boundary, so that a long run is tried once.
MENTION = r"""(?<![\p{L}0-9@_.+(-])[+(]{0,2}+[0-9]++(?:\)?+[\x20.-]?+\(?+[0-9]++)*+|(?<![^\s<>()\[\],;:"])[^\s@<>()\[\],;:"]++@[^\s@<>()\[\],;:"]++"""
#: How much text beside a mention is looked at for a whole word: more, if there is none, at last all.
CONTEXT = (64, 4096)
#: Confident patterns up to this number are broadcast.
FEW = 100_000
_SPAN = "array<struct<s:bigint,k:int,e:bigint,kind:string,m:string>>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        return let(
            F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1),
            lambda d: total + d - F.when(d > 9, 9).otherwise(0),
        )

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _card(m: Column) -> Column:
    return let(_digits(m), lambda d: F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(False))


def _phone(m: Column) -> Column:
    return F.length(_digits(m)).between(9, 15)


def _ip(m: Column) -> Column:
    return F.rlike(m, F.lit(rf"^{_IP_PART}(?:\.{_IP_PART}){{3}}$"))


def base_spans(text: Column) -> Column:
    """Tagged spans of the fixed kinds."""
    none = F.array().cast("array<struct<s:bigint,k:int,e:bigint,kind:string,m:string>>")
    digit = F.rlike(text, F.lit("[0-9]"))
    email = F.when(F.contains(text, F.lit("@")), tagged(match_spans(text, EMAIL, lambda m: F.lit(True)), "email", 0)).otherwise(none)
    ip = F.when(digit, tagged(match_spans(text, IP, _ip), "ip", 1)).otherwise(none)
    card = F.when(digit, tagged(match_spans(text, CARD, _card), "card", 2)).otherwise(none)
    phone = F.when(F.contains(text, F.lit("+")), tagged(match_spans(text, PHONE, _phone), "phone", 3)).otherwise(none)
    return F.concat(email, ip, card, phone)


def _fits(m: Column) -> Column:
    """The kinds that a mention could be of, by its form."""

    def by(d: Column) -> Column:
        n, dotted = F.length(d), F.rlike(m, F.lit(r"^[0-9]+(?:\.[0-9]+){3}$"))
        plain = ~F.contains(m, F.lit("@")) & ~dotted
        kinds = [
            F.when(F.contains(m, F.lit("@")), "email"), F.when(dotted & (n <= 12), "ip"),
            F.when(plain & n.between(12, 19) & F.rlike(m, F.lit(r"^[0-9\x20-]+$")), "card"), F.when(plain & n.between(7, 15), "phone"),
        ]
        return F.array_compact(F.array(*kinds))

    return let(_digits(m), by)


def _word(beside: Column) -> Column:
    return F.lower(F.regexp_replace(beside, r"[^\p{L}]", ""))


def _mentions(text: Column, base: Column) -> Column:
    """Mentions with the kind of the fixed pattern that found them, what they fit, and their lexical patterns."""
    blanks = lambda t: F.translate(t, "\n\r\t\x0b\f", "     ")

    def left(x: Column, reaches: tuple[int, ...] = CONTEXT) -> Column:
        begin = F.greatest(x["s"] - reaches[0], F.lit(0)) if reaches else F.lit(0)
        before = F.rtrim(blanks(F.substring(text, (begin + 1).cast("int"), (x["s"] - begin).cast("int"))))
        if not reaches:
            return before
        # A blank before the last word says that the word is whole.
        return let(before, lambda b: F.when((begin == 0) | F.contains(b, F.lit(" ")), b).otherwise(left(x, reaches[1:])))

    def right(x: Column, reaches: tuple[int, ...] = CONTEXT) -> Column:
        reach = F.lit(reaches[0]) if reaches else F.length(text)
        after = F.ltrim(blanks(F.substring(text, (x["e"] + 1).cast("int"), reach)))
        if not reaches:
            return after
        return let(after, lambda a: F.when((x["e"] + reach >= F.length(text)) | F.contains(a, F.lit(" ")), a).otherwise(right(x, reaches[1:])))

    def one(x: Column, kind: Column, fits: Column) -> Column:
        def patterns(a: Column, b: Column) -> Column:
            some = [F.when(a != "", F.concat(F.lit("l "), a)), F.when(b != "", F.concat(F.lit("r "), b)), F.when((a != "") & (b != ""), F.concat(F.lit("b "), a, F.lit(" "), b))]
            return F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), kind.alias("kind"), fits.alias("fits"), F.array_compact(F.array(*some)).alias("patterns"))

        before, after = _word(F.substring_index(left(x), " ", -1)), _word(F.substring_index(right(x), " ", 1))
        return let(before, lambda a: let(after, lambda b: patterns(a, b)))

    def free(x: Column) -> Column:
        apart = ~F.exists(base, lambda b: (b["s"] < x["e"]) & (b["e"] > x["s"]))
        ends = ~F.rlike(F.substring(text, (x["e"] + 1).cast("int"), F.lit(1)), F.lit(r"[\p{L}_@]"))
        return (F.size(_fits(x["m"])) > 0) & apart & (F.contains(x["m"], F.lit("@")) | ends)

    seeds = F.transform(base, lambda x: one(x, x["kind"], F.array_union(_fits(x["m"]), F.array(x["kind"]))))
    others = F.transform(F.filter(match_spans(text, MENTION, lambda m: F.lit(True)), free), lambda x: one(x, F.lit(None).cast("string"), _fits(x["m"])))
    return F.when(F.rlike(text, F.lit("[0-9@]")), F.concat(seeds, others))


def _hidden(instance: Column, part: int | None) -> Column:
    return F.lit(False) if not part else F.pmod(F.xxhash64(instance), F.lit(part)) == 0


def _normal(m: Column) -> Column:
    """The instance that a mention is one of."""
    return F.when(F.contains(m, F.lit("@")), F.lower(m)).otherwise(F.regexp_replace(m, r"[^0-9.]|(?<=[^0-9])\.", ""))


def detect(
    docs: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = 3, support: int = 5, confidence: float = 0.8, hide: int | None = None
) -> DataFrame:
    """One row per row of docs: key, base (tagged spans), more (tagged spans of discovered identifiers, kind `ctx_<kind>`).

    hide: one in so many instances isn't taken as a seed; what of them is found shows in `more`."""
    content = F.coalesce(F.col(text), F.lit(""))
    one = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(key).alias("key"), content.alias("text"))
    one = one.withColumn("base", base_spans(F.col("text")))
    rows = save(one.select("rid", "key", "base", F.coalesce(let(F.col("base"), lambda b: _mentions(F.col("text"), b)), F.array()).alias("mentions")), "pii")
    mention = rows.select("rid", F.explode("mentions").alias("x")).withColumn("instance", _normal(F.col("x.m")))
    mention = mention.withColumn("known", F.when(~_hidden(F.col("instance"), hide), F.col("x.kind")))
    in_patterns = mention.select("rid", "x.s", "x.e", "x.m", "x.fits", "instance", "known", F.explode("x.patterns").alias("pattern"))
    in_kinds = in_patterns.select("rid", "s", "e", "m", "instance", "known", "pattern", F.explode("fits").alias("kind"))
    edges = save(in_kinds.groupBy("pattern", "kind", "instance").agg(F.max(F.col("known") == F.col("kind")).alias("seed")), "pii-edges")

    def confident(scored: DataFrame, least: float, name: str) -> DataFrame:
        p = scored.groupBy("pattern", "kind").agg(F.avg("c").alias("p"), F.count_if("seed").alias("seeds"))
        p = save(p.filter((F.col("seeds") >= support) & (F.col("p") >= least)).drop("seeds"), name)
        return F.broadcast(p) if p.count() <= FEW else p

    own = F.when(F.col("seed").isNotNull(), F.col("seed").cast("double"))
    scored = edges.withColumn("c", F.coalesce(own, F.lit(0.0)))
    for _ in range(rounds):
        linked = edges.filter("seed is null").join(confident(scored, 0.0, "pii-patterns"), ["pattern", "kind"])
        instances = linked.groupBy("kind", "instance").agg(F.max("p").alias("best"))
        scored = edges.join(instances, ["kind", "instance"], "left").select("pattern", "kind", "instance", "seed", F.coalesce(own, "best", F.lit(0.0)).alias("c"))
    good = confident(scored, confidence, "pii-confident")
    hits = in_kinds.filter("known is null").join(good, ["pattern", "kind"]).groupBy("rid", "s", "e", "m").agg(F.max(F.struct("p", "kind"))["kind"].alias("kind"))
    found = F.collect_list(F.struct("s", F.lit(len(KINDS)).alias("k"), "e", F.concat(F.lit("ctx_"), "kind").alias("kind"), "m"))
    new = hits.groupBy("rid").agg(F.array_sort(found).alias("more"))
    return rows.select("rid", "key", "base").join(new, "rid", "left").select(F.col("key").alias(key), "base", F.coalesce("more", F.array().cast(_SPAN)).alias("more"))


def held_out(docs: DataFrame, key: str = "doc_id", text: str = "text", hide: int = 5, **options) -> DataFrame:
    """By kind: how many spans of hidden instances there are, how many come back as their kind, and as another."""
    got = detect(docs, key, text, hide=hide, **options)
    spans = got.select(F.explode("base").alias("b"), "more").filter(_hidden(_normal(F.col("b.m")), hide))
    over = F.filter("more", lambda x: (x["s"] == F.col("b.s")) & (x["e"] == F.col("b.e")))
    kind = F.try_element_at(over, F.lit(1))["kind"]
    back = F.concat(F.lit("ctx_"), F.col("b.kind"))
    return spans.groupBy("b.kind").agg(F.count("*").alias("hidden"), F.count_if(kind == back).alias("back"), F.count_if(kind != back).alias("as_other"))
