"""Secret scan over a trigram index.

Each rule's pattern is turned into a Boolean query over trigrams: one conjunction for each way
its fixed parts can read, in lower case.  The index lists, for each trigram that some query
names, the rows whose text holds it; intersecting the postings of a conjunction gives the rows
worth reading with that rule, and the pattern itself verifies them.  Rules without mandatory
trigrams read every row.

A rule's spans are its leftmost non-overlapping matches, as code points with the end excluded;
matches whose group is too short are dropped after matching.  Null and empty texts have no
spans, repeated rows each their own, an empty table gives an empty result.  Only DataFrame
functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product
from re import _constants as op, _parser  # the standard library's own parse tree of a pattern

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlight.llm.common import free_name, stored, text_of
from ledgerlight.llm.filters import flagged

#: Ways a pattern may read before a part of it is left out of its query.
MOST_WAYS = 64


@dataclass(frozen=True)
class Rule:
    """``least`` characters are asked of ``group`` (0: the whole match)."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


_VALUE = r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE_RULES = (
    Rule("assign", rf"((?i:password|passwd|secret|token|api_?key)){_VALUE}", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Formats that providers document for their credentials.
EXTRA_RULES = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abps]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + EXTRA_RULES

_GAP = None


def _join(one: tuple, two: tuple) -> tuple:
    """Two readings behind each other; fixed parts that touch become one."""
    if one and two and one[-1] is not _GAP and two[0] is not _GAP:
        return (*one[:-1], one[-1] + two[0], *two[1:])
    return one + two


def _class(items) -> set[str] | None:
    letters: set[str] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            letters.add(chr(value).lower())
        elif kind is op.RANGE and value[1] - value[0] < 8:
            letters.update(chr(c).lower() for c in range(value[0], value[1] + 1))
        else:
            return None
    return letters if len(letters) <= 8 else None


def _ways(tree) -> set[tuple]:
    """All readings of a parse tree as fixed parts (lower case) and gaps."""
    ways = {()}
    for kind, value in tree:
        if kind is op.LITERAL:
            more = {(chr(value).lower(),)}
        elif kind is op.IN:
            letters = _class(value)
            more = {(c,) for c in letters} if letters else {(_GAP,)}
        elif kind is op.BRANCH:
            more = set().union(*(_ways(branch) for branch in value[1]))
        elif kind is op.SUBPATTERN:
            more = _ways(value[3])
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            least, most, inner = value
            body = _ways(inner)
            if most == 1:
                more = body if least else body | {()}
            elif least and len(body) == 1:
                more = {(*next(iter(body)), _GAP)}
            else:
                more = {(_GAP,)}
        elif kind is op.AT:
            more = {()}
        else:
            more = {(_GAP,)}
        if len(ways) * len(more) > MOST_WAYS:
            more = {(_GAP,)}
        ways = {_join(a, b) for a, b in product(ways, more)}
    return ways


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """A disjunction of trigram sets that every text with a match satisfies; None if there is none."""
    query = set()
    for way in _ways(_parser.parse(pattern)):
        grams = frozenset(
            part[i:i + 3] for part in way if part is not _GAP for i in range(len(part) - 2)
        )
        if not grams:
            return None
        query.add(grams)
    # a conjunction that asks for more than another adds nothing
    return sorted((c for c in query if not any(d < c for d in query)), key=sorted)


def vocabulary(rules: Sequence[Rule]) -> list[str]:
    """The trigrams that the rules' queries name."""
    queries = [trigram_query(rule.pattern) for rule in rules]
    return sorted({gram for query in queries if query for conjunction in query for gram in conjunction})


def row_key(id_column: str, text_column: str) -> Column:
    """What postings name a row by; rows that share a key share id and text."""
    return F.xxhash64(F.col(f"`{id_column}`").cast("string"), F.col(f"`{text_column}`").cast("string"))


def postings(docs: DataFrame, grams: Sequence[str], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The inverted index: (gram, row_key) for each row whose text holds the trigram in any case."""
    # the lambda's argument is worked out once for all trigrams
    held = F.element_at(F.transform(
        F.array(F.lower(text_of(text_column))),
        lambda folded: F.array(*[F.when(F.contains(folded, F.lit(gram)), F.lit(gram)) for gram in grams]),
    ), 1)
    return docs.select(
        F.explode(F.array_compact(held)).alias("gram"), row_key(id_column, text_column).alias("row_key")
    )


def candidates(index: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(row_key, rule numbers): rows in the intersected postings of some conjunction.

    A row's postings are gathered as bits, folded in each task before they are shuffled.
    """
    grams = vocabulary(rules)
    place = {gram: divmod(n, 62) for n, gram in enumerate(grams)}
    words = range(len(grams) // 62 + 1)
    bits = F.create_map(*[F.lit(x) for gram in grams for x in (gram, 1 << place[gram][1])])
    number = F.create_map(*[F.lit(x) for gram in grams for x in (gram, place[gram][0])])
    rows = index.select(
        "row_key", F.element_at(bits, F.col("gram")).alias("bit"), F.element_at(number, F.col("gram")).alias("word")
    ).groupBy("row_key").agg(*[
        F.bit_or(F.when(F.col("word") == w, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(f"held_{w}")
        for w in words
    ])
    hits = []
    for number, rule in enumerate(rules):
        query = trigram_query(rule.pattern)
        if query is None:
            continue
        either = F.lit(False)
        for conjunction in query:
            every = F.lit(True)
            for w in words:
                asked = sum(1 << place[gram][1] for gram in conjunction if place[gram][0] == w)
                if asked:
                    every &= F.col(f"held_{w}").bitwiseAND(F.lit(asked)) == asked
            either |= every
        hits.append(F.when(either, F.lit(number)))
    if not hits:
        return rows.select("row_key", F.array().cast("array<int>").alias("rules")).limit(0)
    return rows.select("row_key", F.array_compact(F.array(*hits)).alias("rules")).filter(F.size("rules") > 0)


def _spans(text: Column, number: int, rule: Rule) -> Column:
    """The rule's matches: what lies between them, from a split, gives their places."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    asked = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    between = F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(whole))
    steps = F.arrays_zip(between.alias("gap"), whole.alias("found"), asked.alias("asked"))
    nothing = F.array().cast("array<struct<start:long,number:int,end:long,asked:int>>")
    walked = F.aggregate(
        steps, F.struct(F.lit(0).cast("long").alias("at"), nothing.alias("spans")),
        lambda state, step: F.struct(
            (state["at"] + F.length(step["gap"]) + F.length(step["found"])).alias("at"),
            F.concat(state["spans"], F.array(F.struct(
                (state["at"] + F.length(step["gap"])).alias("start"), F.lit(number).alias("number"),
                (state["at"] + F.length(step["gap"]) + F.length(step["found"])).alias("end"),
                F.length(step["asked"]).alias("asked"),
            ))).alias("spans"),
        ),
    )["spans"]
    return F.filter(walked, lambda span: span["asked"] >= rule.least)


def scan(
    docs: DataFrame, rules: Sequence[Rule] = RULES, id_column: str = "doc_id", text_column: str = "text",
    output: str = "secrets",
) -> DataFrame:
    """``docs`` with an array of (kind, start, end, found), by start, then kind as listed.

    The array replaces a column of its name.
    """
    key, hits = free_name(docs, "_row_key"), free_name(docs, "_rules")
    found = stored(candidates(postings(docs, vocabulary(rules), id_column, text_column), rules))
    # only rows that a bitmap of the candidates lets pass are joined with them; the others' texts stay where they are
    flag = free_name(docs, "_may_match")
    keyed = flagged(docs.withColumn(key, row_key(id_column, text_column)), key, found, "row_key", flag)
    wanted = found.select(F.col("row_key").alias(key), F.col("rules").alias(hits))
    some = keyed.filter(F.col(flag)).join(wanted, key, "left")
    rest = keyed.filter(~F.col(flag)).withColumn(hits, F.lit(None).cast("array<int>"))
    joined = some.unionByName(rest).drop(flag)
    text = text_of(text_column)
    nothing = F.array().cast("array<struct<start:long,number:int,end:long,asked:int>>")
    each = []
    for number, rule in enumerate(rules):
        spans = _spans(text, number, rule)
        if trigram_query(rule.pattern) is None:
            each.append(F.when(F.regexp_like(text, F.lit(rule.pattern)), spans).otherwise(nothing))
        else:
            each.append(F.when(F.array_contains(hits, number), spans).otherwise(nothing))
    kinds = F.array(*[F.lit(rule.kind) for rule in rules])
    spans = F.transform(
        F.array_sort(F.concat(*each)),
        lambda span: F.struct(
            F.get(kinds, span["number"]).alias("kind"), span["start"].alias("start"), span["end"].alias("end"),
            F.substring(text, (span["start"] + 1).cast("int"), (span["end"] - span["start"]).cast("int")).alias("found"),
        ),
    )
    return joined.withColumn(output, spans).drop(key, hits)


def summary(scanned: DataFrame, rules: Sequence[Rule] = BASE_RULES, output: str = "secrets") -> list[Column]:
    """Counts per base kind, the digest of base spans, and all spans as text."""
    def shown(spans: Column) -> Column:
        return F.array_join(F.transform(
            spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
        ), ",")

    def of(kind: str) -> Column:
        return F.filter(F.col(output), lambda s: s["kind"] == kind)

    base = [rule.kind for rule in rules]
    return [
        *[F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in base],
        F.sha2(shown(F.filter(F.col(output), lambda s: s["kind"].isin(base))).cast("binary"), 256).alias("base_sha256"),
        shown(F.col(output)).alias("spans"),
    ]
