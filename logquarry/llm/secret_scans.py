"""Secret scans with a trigram inverted index, in DataFrame functions alone.

Each rule's regex gives a Boolean query over the trigrams that every match must hold. Posting lists of those trigrams,
a list for each trigram and block of documents, are united and intersected as the query says; the documents that are
left are verified with the regex. Rules without mandatory trigrams scan every document.

Defined cases: a null text counts as empty; a null doc_id is not in the index and is scanned by every rule; rows with
one doc_id are verified each for itself; an empty table gives an empty result; ``redact`` carries further columns.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.llm.common import free_name, table

#: Documents in a block of the index, about.
BLOCK_ROWS = 4096
#: Alternatives that a part of a regex is expanded to, at most; a part with more is left out of the query.
ALTERNATIVES = 64


@dataclass(frozen=True)
class Rule:
    """group: what must have at_least characters; a shorter match is dropped after it was consumed."""

    kind: str
    regex: str
    group: int = 0
    at_least: int = 1


BASE = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        8,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}"),  # the same spans as runs of any length, the short ones dropped
)
ADDED = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
)


def _strings(items) -> tuple[set[str] | None, list[set[str]]]:
    """All strings that a part can match, or None, and sets of strings of which every match holds one each."""
    exact: set[str] | None = {""}
    run: set[str] = {""}
    factors: list[set[str]] = []
    for op, arg in items:
        own: set[str] | None = None
        inner: list[set[str]] = []
        if op is C.LITERAL:
            own = {chr(arg).lower()}
        elif op is C.IN and all(x[0] is C.LITERAL for x in arg):
            own = {chr(x[1]).lower() for x in arg}
        elif op is C.SUBPATTERN:
            own, inner = _strings(arg[3])
        elif op is C.BRANCH:
            parts = [_strings(x)[0] for x in arg[1]]
            own = None if None in parts else set().union(*parts)
        elif op is C.MAX_REPEAT and arg[1] <= 3:
            one, _ = _strings(arg[2])
            if one is not None:
                own, power = set(), {""}
                for i in range(arg[1] + 1):
                    own |= power if i >= arg[0] else set()
                    power = {a + b for a in power for b in one}
        grown = None if own is None else {a + b for a in run for b in own}
        if grown is not None and len(grown) <= ALTERNATIVES:
            run = grown
        else:
            factors += [run, *inner]
            run, exact = {""} if own is None else own, None
    factors.append(run)
    return (run if exact is not None else None), factors


def trigram_query(regex: str) -> list[list[list[str]]]:
    """AND over parts, OR over a part's strings, AND over a string's trigrams, in lower case; empty: no trigram is mandatory."""
    _, factors = _strings(_parser.parse(regex))
    query = []
    for part in factors:
        if min(map(len, part)) >= 3:
            held = [{s[i : i + 3] for i in range(len(s) - 2)} for s in sorted(part, key=lambda s: (len(s), s))]
            # A string that asks for all that another asks for, and more, adds no document.
            query.append([sorted(h) for i, h in enumerate(held) if not any(x <= h for x in held[:i])])
    return query


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, kinds): for each document the rules with trigram queries that it satisfies; documents with none are left out."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.regex))}
    vocabulary = sorted({t for q in queries.values() for part in q for s in part for t in s})
    blocks = max(1, docs.count() // BLOCK_ROWS)
    low = docs.where("doc_id IS NOT NULL").select("doc_id", F.lower("text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in vocabulary]))
    postings = (
        low.select("doc_id", F.explode(held).alias("trigram"))
        .groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).alias("block"), "trigram")
        .agg(F.collect_set("doc_id").alias("ids"))
    )
    index = postings.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "ids"))).alias("lists"))
    none = F.array().cast("array<bigint>")

    def posting(trigram: str) -> Column:
        return F.coalesce(F.try_element_at("lists", F.lit(trigram)), none)

    def met(query: list[list[list[str]]]) -> Column:
        parts = []
        for part in query:
            strings = []
            for trigrams in part:
                ids = posting(trigrams[0])
                for t in trigrams[1:]:
                    ids = F.array_intersect(ids, posting(t))
                strings.append(ids)
            ids = strings[0]
            for other in strings[1:]:
                ids = F.array_union(ids, other)
            parts.append(ids)
        ids = parts[0]
        for other in parts[1:]:
            ids = F.array_intersect(ids, other)
        return ids

    per_rule = F.array(*[F.struct(F.lit(k).alias("kind"), met(q).alias("ids")) for k, q in queries.items()])
    return (
        index.select(F.explode(per_rule).alias("hit"))
        .select("hit.kind", F.explode("hit.ids").alias("doc_id"))
        .groupBy("doc_id")
        .agg(F.collect_set("kind").alias("kinds"))
    )


def _located(matches: Column, gaps: Column, wanted: Column, rule: Rule, order: int) -> Column:
    """Spans of a rule's matches in code points, from the matches and the texts between them."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind_order:int,end:int,kind:string>>").alias("spans"))

    def step(acc: Column, i: Column) -> Column:
        begin = acc["at"] + F.length(F.get(gaps, i))
        end = begin + F.length(F.get(matches, i))
        span = F.struct(
            begin.alias("start"), F.lit(order).alias("kind_order"), end.alias("end"), F.lit(rule.kind).alias("kind")
        )
        kept = F.length(F.get(wanted, i)) >= rule.at_least
        return F.struct(end.alias("at"), F.when(kept, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.when(
        F.size(matches) > 0, F.aggregate(F.sequence(F.lit(0), F.size(matches) - 1), start, step, lambda acc: acc["spans"])
    ).otherwise(F.array())


def with_spans(docs: DataFrame, rules: tuple[Rule, ...] = BASE + ADDED) -> DataFrame:
    """``docs`` with a column of all spans (start, kind_order, end, kind), in code points, sorted; its name is the last column's."""
    found = candidates(docs, rules)
    key, kinds, spans = free_name(docs, "candidate_id"), free_name(docs, "candidate_kinds"), free_name(docs, "spans")
    found = found.select(F.col("doc_id").alias(key), F.col("kinds").alias(kinds))
    rows = docs.join(found, docs["doc_id"] == F.col(key), "left").drop(key)
    text = F.coalesce(F.col("text"), F.lit(""))
    empty = F.array().cast("array<string>")
    first, second, names = {}, {}, {}
    for r in rules:
        m, g, w = (free_name(docs, f"{x}_{r.kind}") for x in ("matches", "gaps", "wanted"))
        due = F.array_contains(kinds, r.kind) | F.col("doc_id").isNull() if trigram_query(r.regex) else F.lit(True)
        first[m] = F.when(due, F.regexp_extract_all(text, F.lit(r.regex), F.lit(0))).otherwise(empty)
        some = F.size(m) > 0
        second[g] = F.when(some, F.split(text, r.regex, -1)).otherwise(empty)
        second[w] = F.when(some, F.regexp_extract_all(text, F.lit(r.regex), F.lit(r.group))).otherwise(empty) if r.group else F.col(m)
        names[r] = (m, g, w)
    located = [_located(F.col(m), F.col(g), F.col(w), r, i) for i, (r, (m, g, w)) in enumerate(names.items())]
    rows = rows.withColumns(first).withColumns(second).withColumn(spans, F.array_sort(F.concat(*located)))
    return rows.select(*docs.columns, spans)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = BASE + ADDED) -> DataFrame:
    """``docs`` with each secret replaced by ``[kind]``; overlapping ones become one; n_chars, if there, follows the text."""
    rows = with_spans(docs, rules)
    spans = rows.columns[-1]
    text = F.col("text")

    def step(acc: Column, s: Column) -> Column:
        begin = F.greatest(acc["at"], s["start"])
        mask = F.concat(acc["out"], F.substr(text, acc["at"] + 1, begin - acc["at"]), F.lit("["), s["kind"], F.lit("]"))
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["end"] > acc["at"], mask).otherwise(acc["out"]).alias("out")
        )

    masked = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        step,
        lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)),
    )
    rows = rows.withColumn("text", F.when(F.size(spans) > 0, masked).otherwise(text)).drop(spans)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = with_spans(docs)

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind_order"] < len(BASE))
    return rows.select(
        "doc_id",
        *[count(r.kind) for r in BASE],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )
