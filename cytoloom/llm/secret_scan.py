"""Secret scan with built-in functions only: a trigram inverted index narrows the documents that each rule's regex must verify."""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """kind: its name; regex: what to find; least: code points that `group` of a match must have (0: the match), else it is dropped."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1


_ANY_CASE = lambda s: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in s)
#: The base kinds come first. Shortest runs stand in the regexes where every match below them fails.
RULES = [
    Rule("assign", "(" + "|".join(map(_ANY_CASE, ["password", "passwd", "secret", "token", "api_?key"])) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", "AKIA[A-Z0-9]{16,}"),
    Rule("hex", "[0-9a-f]{24,}"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("url", r"[a-z][a-z0-9+.-]{1,20}://[^\x20\x09-\x0D/:@]*:[^\x20\x09-\x0D/@]{3,}@"),
]
BASE = ("assign", "access", "hex")
#: The rules of redaction. RULES are those of the query's SQL, whose private key is the header line alone, and whose url ends at the first
#: @; here a key goes on to its END line, or else over the lines of key that follow the header, and a url to the last @ of its host
#: part. Runs don't backtrack, so that long ones need neither stack nor time.
WHOLE = [
    *RULES[:7],
    Rule("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:(?!-----(?:BEGIN|END) )[\s\S])*+-----END [A-Z ]*PRIVATE KEY-----|(?:\s*+(?:Proc-Type|DEK-Info):[^\n]*+)*+(?:(?:\s|\\[nr])*+[A-Za-z0-9+/]{40,}+={0,2}+)*+(?:(?<=[A-Za-z0-9+/=]{40})\s++[A-Za-z0-9+/]++={0,2}+(?=[\r\n]|$))?+)"),
    Rule("url", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:]*+:(?=[^\s/]{3,}?@)(?:[^\s/@]*+@)++"),
]
#: At most so many strings are followed through a choice before it counts as open.
WIDEST = 64


def trigram_query(regex: str) -> list[list[frozenset[str]]] | None:
    """What a text must hold for the regex to match: for every element one of its alternatives, of which all lower-case trigrams.
    None: the regex has no mandatory trigram. Literals, small classes, groups, choices and repeats are followed (Cox 2012)."""
    import re._parser as parser

    needs: list[list[frozenset[str]]] = []

    def grams(s: str) -> frozenset[str]:
        return frozenset(s[i : i + 3] for i in range(len(s) - 2))

    def close(exact: set[str], out: list) -> None:
        found = [grams(s) for s in exact]
        if found and all(found):  # an alternative that asks for more than another adds nothing
            out.append(sorted({f for f in found if not any(g < f for g in found)}, key=sorted))

    def walk(items, out: list) -> None:
        run = {""}
        for op, arg in items:
            options = strings(op, arg)
            if options is not None and len(run) * len(options) <= WIDEST:
                run = {a + b for a, b in itertools.product(run, options)}
                continue
            close(run, out)
            run = {""}
            name = str(op)
            if options is not None:
                run = options
            elif name == "SUBPATTERN":
                walk(arg[3], out)
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] > 0:
                walk(arg[2], out)
            elif name == "BRANCH":
                parts = []
                for branch in arg[1]:
                    walk(branch, inner := [])
                    parts.append(inner)
                if all(parts):  # whichever branch holds, one of its requirements is met
                    out.append([alt for p in parts for alt in p[0]])
        close(run, out)

    def strings(op, arg) -> set[str] | None:
        """All lower-case strings that an item can be, if they are few."""
        name = str(op)
        if name == "LITERAL":
            return {chr(arg).lower()}
        if name == "IN" and all(str(k) in ("LITERAL", "RANGE") for k, _ in arg):
            chars = {chr(c).lower() for k, v in arg for c in (range(v[0], v[1] + 1) if str(k) == "RANGE" else [v])}
            return chars if len(chars) <= 5 else None
        if name == "SUBPATTERN":
            return _product(arg[3])
        if name == "BRANCH":
            parts = [_product(b) for b in arg[1]]
            return set().union(*parts) if all(p is not None for p in parts) and sum(map(len, parts)) <= WIDEST else None
        if name == "MAX_REPEAT" and arg[1] <= 1:
            inner = _product(arg[2])
            return None if inner is None else inner | ({""} if arg[0] == 0 else set())
        return None

    def _product(items) -> set[str] | None:
        run = {""}
        for op, arg in items:
            options = strings(op, arg)
            if options is None or len(run) * len(options) > WIDEST:
                return None
            run = {a + b for a, b in itertools.product(run, options)}
        return run

    walk(parser.parse(regex), needs)
    return needs or None


def build_index(docs: DataFrame, trigrams: list[str], key: str, text: str = "text") -> DataFrame:
    """Postings (trigram, key) of the given trigrams, in any case, over whole texts: an inverted index with a fixed dictionary."""
    low = docs.select(F.col(key), F.lower(F.col(text)).alias("_t")).where("_t IS NOT NULL")
    held = F.array(*[F.when(F.contains(F.col("_t"), F.lit(g)), F.lit(g)) for g in trigrams])
    return low.select(F.explode(F.array_compact(held)).alias("trigram"), key)


def candidates(postings: DataFrame, rules: list[Rule], key: str) -> DataFrame:
    """(key, kinds): for every key the rules with mandatory trigrams whose Boolean query its postings satisfy.

    The postings lists are joined with the queries' terms and intersected by counting: a list of alternatives is met if all
    trigrams of one of them are there, a rule if all its lists are.
    """
    spark = postings.sparkSession
    terms = [(r.kind, n, len(q), a, len(alt), g) for r in rules if (q := trigram_query(r.regex)) for n, any_of in enumerate(q) for a, alt in enumerate(any_of) for g in sorted(alt)]
    if not terms:
        return postings.select(key).where(F.lit(False)).withColumn("kinds", F.array().cast("array<string>"))
    query = spark.createDataFrame(terms, "kind string, need int, needs int, alt int, alts int, trigram string")  # a few hundred rows at most
    hits = postings.distinct().join(F.broadcast(query), "trigram").groupBy(key, "kind", "need", "needs", "alt", "alts").count()
    met = hits.where("count = alts").select(key, "kind", "need", "needs").distinct().groupBy(key, "kind", "needs").count()
    return met.where("count = needs").groupBy(key).agg(F.collect_set("kind").alias("kinds"))


def _placed(items: Column, chunk: int = 256) -> Column:
    """Running sums over (gap, size, m): chunk by chunk, so that long arrays aren't copied for every item."""
    size = lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + x["gap"] + x["size"])
    place = lambda s, x: F.struct((s["at"] + x["gap"] + x["size"]).alias("at"), F.concat(s["out"], F.array(F.struct((s["at"] + x["gap"]).alias("start"), (s["at"] + x["gap"] + x["size"]).alias("end"), x["m"].alias("m")))).alias("out"))
    inner = lambda at, c: F.aggregate(c, F.struct(at.alias("at"), F.array().cast("array<struct<start:int,end:int,m:string>>").alias("out")), place, lambda s: s["out"])
    chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(items) - 1, F.lit(0)), F.lit(chunk)), lambda i: F.slice(items, i + 1, F.lit(chunk)))
    seed = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,end:int,m:string>>>").alias("out"))
    step = lambda s, c: F.struct((s["at"] + size(c)).alias("at"), F.concat(s["out"], F.array(inner(s["at"], c))).alias("out"))
    return F.flatten(F.aggregate(chunks, seed, step, lambda s: s["out"]))


def spans(text: Column, rule: Rule) -> Column:
    """Array of (start, end, kind) of the rule's matches, in code points, end exclusive: leftmost and not overlapping. The pieces
    between matches and the matches give the places, as both walk the text by the same regex."""
    found = F.regexp_extract_all(text, F.lit(f"({rule.regex})"), F.lit(1))
    lengths = F.zip_with(found, F.split(text, rule.regex, -1), lambda m, gap: F.struct(F.length(gap).alias("gap"), F.length(m).alias("size"), m.alias("m")))
    lengths = F.filter(lengths, lambda x: x["m"].isNotNull())
    placed = _placed(lengths)
    if rule.least > 1:
        placed = F.filter(placed, lambda x: F.length(F.regexp_extract(x["m"], rule.regex, rule.group)) >= rule.least)
    return F.transform(placed, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(rule.kind).alias("kind")))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: list[Rule] = WHOLE) -> DataFrame:
    """Adds `secrets`, an array of (start, kind, end) sorted by start and then by the rules' order, to every row, from its whole text.

    Rules with mandatory trigrams verify only the candidates of the inverted index; the others scan every text. The index has postings of
    the rules' own trigrams, by a hash of key and text, so that null and repeated keys are spread like others; should two rows' hashes be
    equal, they share their candidates, and each row is verified on its own text. Null and empty texts have no secrets. Other columns
    stay, whatever their names; one named secrets is replaced.
    """
    queries = {r.kind: trigram_query(r.regex) for r in rules}
    dictionary = sorted({g for q in queries.values() if q for any_of in q for alt in any_of for g in alt})
    names = [c for c in docs.columns if c != "secrets"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"), F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`")).alias("place"))
    found = candidates(build_index(rows, dictionary, "place", "t"), rules, "place").select(F.col("place").alias("of"), "kinds")
    df = rows.join(found, F.col("place") == F.col("of"), "left")
    order, t = {r.kind: i for i, r in enumerate(rules)}, F.col("t")
    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    parts = []
    for r in rules:
        if queries[r.kind]:
            parts.append(F.when(F.array_contains(F.col("kinds"), r.kind), spans(t, r)).otherwise(none))
        else:  # no index helps: every text that has such a match at all
            parts.append(F.when(t.rlike(r.regex), spans(t, r)).otherwise(none))
    rank = F.create_map(*[F.lit(x) for k, i in order.items() for x in (k, i)])
    keys = F.transform(F.concat(*parts), lambda x: F.struct(x["start"].alias("start"), rank[x["kind"]].alias("rank"), x["kind"].alias("kind"), x["end"].alias("end")))
    found = F.transform(F.sort_array(keys), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    return df.select("row", found.alias("secrets")).select("row.*", "secrets")


def redact(docs: DataFrame, text: str = "text", secrets: str = "secrets", mark: str = "[SECRET]") -> DataFrame:
    """Replaces every span by `mark`; spans that overlap or touch count as one. Rows without spans keep their text, null too."""
    seed = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    before = lambda s, x: F.substring(F.col(text), s["at"] + 1, x["start"] - s["at"])
    more = lambda s, x: F.when(x["start"] < s["at"], s["out"]).when((x["start"] == s["at"]) & (s["at"] > 0), s["out"]).otherwise(F.concat(s["out"], F.array(before(s, x), F.lit(mark))))
    step = lambda s, x: F.struct(F.greatest(s["at"], x["end"]).alias("at"), more(s, x).alias("out"))
    rest = lambda s: F.substring(F.col(text), s["at"] + 1, F.length(F.col(text)))
    whole = F.aggregate(F.col(secrets), seed, step, lambda s: F.array_join(F.concat(s["out"], F.array(rest(s))), ""))
    return docs.withColumn(text, F.when(F.size(secrets) > 0, whole).otherwise(F.col(text)))


def as_text(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
