"""Secret scanning with a trigram index, on DataFrame functions alone.

Every rule's regular expression gives a Boolean query of trigrams that any match must hold (ANDs of ORs, derived from the
expression's own parse). The inverted index is a table of postings (trigram, document) for the trigrams that the rules ask for; joined with the
queries and counted by document, postings intersect without texts. Only documents left by a rule's query are
verified with its expression; a rule without a mandatory trigram scans all.

Places are counted in code points: the pieces between matches and the matches themselves add up to the text.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from displace.session import materialize

#: The rules. The first three are the base; group is what counts for least. A run of at least n characters is asked for in the
#: expression itself where no shorter match could hide another one: the common case, short runs of hex letters, then never leaves the
#: regular expression engine.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int = 0
    group: int = 0


BASE = (Rule("assign", ASSIGN, 6, 2), Rule("access", ACCESS), Rule("hex", HEX))
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("bearer", r"Bearer\x20+[A-Za-z0-9._~+/-]{20,}"),
)

_LIMIT = 16
Query = frozenset | None  # a conjunction of alternatives: frozenset of frozensets of trigrams; empty: no demand


def _strings(node) -> set[str] | None:
    """All strings that an element can match, lower-cased, if they are few; else None."""
    op, arg = str(node[0]), node[1]
    if op == "LITERAL":
        return {chr(arg).lower()}
    if op == "IN" and all(str(k) == "LITERAL" for k, _ in arg) and len(arg) <= 4:
        return {chr(v).lower() for _, v in arg}
    if op == "SUBPATTERN":
        return _sequence_strings(arg[3])
    if op == "BRANCH":
        return _all([_sequence_strings(b) for b in arg[1]])
    if op == "MAX_REPEAT" and arg[1] <= 2:
        inner = _sequence_strings(arg[2])
        if inner is None:
            return None
        out = {""} if arg[0] == 0 else set()
        power = {""}
        for i in range(1, int(arg[1]) + 1):
            power = {a + b for a in power for b in inner}
            if i >= arg[0]:
                out |= power
        return out if len(out) <= _LIMIT else None
    return None


def _all(parts) -> set[str] | None:
    if any(p is None for p in parts):
        return None
    out = set().union(*parts)
    return out if len(out) <= _LIMIT else None


def _sequence_strings(seq) -> set[str] | None:
    out = {""}
    for node in seq:
        s = _strings(node)
        if s is None:
            return None
        out = {a + b for a in out for b in s}
        if len(out) > _LIMIT:
            return None
    return out


def _demand(texts: set[str]) -> frozenset:
    """What a text that holds one of these strings must hold: per string the AND of its trigrams; together an OR of them."""
    options = frozenset(frozenset(t[i : i + 3] for i in range(len(t) - 2)) for t in texts)
    return frozenset() if frozenset() in options else frozenset([options])


def trigram_query(pattern: str) -> frozenset:
    """AND over demands; a demand is an OR of ANDs of lower-case trigrams. Empty if nothing is mandatory."""
    return _query(parser.parse(pattern))


def _query(seq) -> frozenset:
    found, run = frozenset(), {""}
    for node in seq:
        s = _strings(node)
        joined = {a + b for a in run for b in s} if s is not None else None
        if joined is not None and len(joined) <= _LIMIT:
            run = joined
            continue
        found, run = found | _demand(run), s if s is not None else {""}
        op, arg = str(node[0]), node[1]
        if s is None and op == "SUBPATTERN":
            found |= _query(arg[3])
        elif s is None and op == "MAX_REPEAT" and arg[0] >= 1:
            found |= _query(arg[2])
    return found | _demand(run)


def _spans(text: str, rule: Rule) -> Column:
    """All matches of a rule that are long enough, as (start, kind, end)."""
    pieces, whole = F.split(F.col(text), rule.pattern, -1), F.regexp_extract_all(F.col(text), F.lit(rule.pattern), 0)
    counted = F.regexp_extract_all(F.col(text), F.lit(rule.pattern), rule.group) if rule.group else whole
    rows = F.arrays_zip(F.transform(pieces, F.length).alias("gap"), F.transform(whole, F.length).alias("size"), F.transform(counted, F.length).alias("counted"))
    placed = F.aggregate(
        rows,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,counted:int>>").alias("out")),
        lambda acc, r: F.struct((acc["at"] + r["gap"] + F.coalesce(r["size"], F.lit(0))).alias("at"), F.when(r["size"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct((acc["at"] + r["gap"]).alias("start"), (acc["at"] + r["gap"] + r["size"]).alias("end"), r["counted"].alias("counted"))))).alias("out")),
        lambda acc: acc["out"],
    )
    return F.transform(F.filter(placed, lambda m: m["counted"] >= rule.least), lambda m: F.struct(m["start"].alias("start"), F.lit(rule.kind).alias("kind"), m["end"].alias("end")))


NOTHING = "array<struct<start:int,kind:string,end:int>>"


def _grams(rules: tuple[Rule, ...]) -> list[str]:
    """All trigrams that the rules' queries name, in order; a posting names one by its place."""
    return sorted({g for r in rules for demand in trigram_query(r.pattern) for option in demand for g in option})


def postings(docs: DataFrame, key: str, text: str, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """The inverted index of the rules' trigrams: (gram, key) for each of them that a text holds, A-Z lower-cased, once."""
    low = docs.select(key, F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("_low"))
    held = F.array_compact(F.array(*[F.when(F.contains("_low", F.lit(g)), i) for i, g in enumerate(_grams(rules))]))
    return low.select(key, F.explode(held).alias("gram")).repartition(key).distinct().select("gram", key)


def candidates(index: DataFrame, key: str, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """(key, rules): the rules whose Boolean query a text's postings satisfy. Postings are intersected by keys: an option is met where all its trigrams
    are posted, a demand where one of its options is, a rule where all its demands are. One exchange by key, so a trigram that every text
    holds is in no task as a whole."""
    at = {g: i for i, g in enumerate(_grams(rules))}
    plan = [(at[g], i, d, o, len(option)) for i, r in enumerate(rules) for d, demand in enumerate(sorted(trigram_query(r.pattern), key=str)) for o, option in enumerate(sorted(demand, key=sorted)) for g in sorted(option)]
    demands = [(i, len(trigram_query(r.pattern))) for i, r in enumerate(rules) if trigram_query(r.pattern)]
    spark = index.sparkSession
    asked = F.broadcast(spark.createDataFrame(plan, "gram int, rule int, demand int, option int, grams int"))  # as many rows as the rules have trigrams
    needs = F.broadcast(spark.createDataFrame(demands, "rule int, demands int"))
    options = index.repartition(key).join(asked, "gram").groupBy(key, "rule", "demand", "option", "grams").count().where("count = grams")
    met = options.select(key, "rule", "demand").distinct().groupBy(key, "rule").count().join(needs, "rule").where("count = demands")
    return met.groupBy(key).agg(F.collect_list("rule").alias("rules"))


def find_secrets(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = BASE + MORE, id_col: str = "doc_id") -> DataFrame:
    """docs with `secrets`, an array of (start, kind, end) by start and then in the rules' order: leftmost non-overlapping matches per rule, those
    whose counted group is shorter than the rule's least dropped. Null and empty texts have none; rows and other columns stay as they are, whatever their names
    (a column `secrets` is replaced); repeated rows have the same secrets; an empty table gives no rows.

    The index of the rules' trigrams is written to the shared folder. A text is known in it by a hash of id and text: equal hashes only add candidates,
    and every candidate is verified by the rule's expression. Rules without a mandatory trigram scan all texts.
    """
    passed = [c for c in docs.columns if c != "secrets"]
    known = [F.col(id_col)] if id_col in docs.columns else []
    own = docs.select(F.struct(*passed).alias("_row"), F.coalesce(F.col(text), F.lit("")).alias("_text"), F.xxhash64(*known, text).alias("_key"))
    index = materialize(postings(own, "_key", "_text", rules), "trigrams")
    held = own.join(candidates(index, "_key", rules), "_key", "left")
    asked = lambda i, r: F.array_contains("rules", F.lit(i)) if trigram_query(r.pattern) else F.lit(True)
    spans = [F.when(asked(i, r), _spans("_text", r)).otherwise(F.array().cast(NOTHING)) for i, r in enumerate(rules)]
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    found = held.withColumn("_found", F.concat(*spans))
    ranked = F.array_sort(F.transform("_found", lambda s: F.struct(s["start"].alias("start"), F.element_at(order, s["kind"]).alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return found.select("_row.*", F.transform(ranked, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))).alias("secrets"))


def redact(found: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """Replace every reported span by `mark`; spans that overlap give one mark. Needs the column `secrets`; a null text stays null."""
    # cut points: (at, +1) where a span starts, (at, -1) where it ends, merged from left to right
    merged = F.aggregate(
        "secrets",
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda done, s: F.when((F.size(done) > 0) & (F.element_at(done, -1)["end"] > s["start"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end"))))).otherwise(F.concat(done, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))),
    )
    built = F.aggregate(
        merged,
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, s: F.struct(F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)).alias("out"), s["end"].alias("at")),
        lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, F.length(F.col(text)))),
    )
    return found.withColumn(text, F.when(F.size("secrets") > 0, built).otherwise(F.col(text)))


def secrets_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long")
    say = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("secrets", lambda s: s["kind"].isin(*[r.kind for r in BASE]))
    return found.select(id_col, count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(say(base), 256).alias("base_sha256"), say(F.col("secrets")).alias("spans"))
