"""Secrets in texts, with SQL functions only: three rules, and two character Markov models compared by likelihood.

Positions come from cutting a text at a rule's matches: a match begins behind all pieces and matches before it. The models,
one of random strings and one of ordinary identifiers, are tables of character pairs counted from labelled samples; a token, or what the
rules leave of it, is a secret if the random model makes it far more likely.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The rules and the least length of what they match.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"  # whole runs of 32 or more, which is what is left of all runs
LEAST_VALUE, LEAST_ACCESS = 8, 16
KINDS = ("assign", "access", "hex", "random")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"
LETTERS = 52  # the first ones of the alphabet
TOKEN = r"[A-Za-z0-9+/=_-]{16,}"
RULED = rf"AKIA[A-Z0-9]{{{LEAST_ACCESS - 4},}}|{HEX}"  # what the other two rules take of a token
SPAN = "array<struct<start:int,kind:int,end:int>>"

#: Texts from which the models are counted at most, on average: those whose hashed id falls in the share that gives so many.
TRAINING_TEXTS = 4000
#: Natural logarithm of the ratio of likelihoods from which on a token is a secret, in all and per pair of characters.
LEAST_RATIO, LEAST_MEAN = 18.0, 0.8
#: The same for tokens without a digit, whose pairs of letters alone count, as they are and in lower case: names have capitals and signs too.
LEAST_RATIO_LETTERS, LEAST_MEAN_LETTERS = 24.0, 1.2
#: Pairs' worth of belief in how common a character is by itself, where a model has seen few pairs.
BACKING = 5.0


#: Matches whose places are added up by one fold; a fold copies what it has so far at each step.
FOLDED = 256


def _bound(value: Column, use) -> Column:
    """`use` of a value that is made once, however often a lambda mentions it."""
    return F.transform(F.array(value), use)[0]


def _blocks(values: Column) -> Column:
    last = F.greatest(F.ceil(F.size(values) / FOLDED).cast("int") - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(values, k * FOLDED + 1, F.lit(FOLDED)))


def _running(values: Column, begin: Column, combine) -> Column:
    """For each of some non-negative integers, what `combine` makes of `begin` and those before it. In blocks, so that the work follows the
    number of values and not its square."""

    def fold(some: Column, first: Column) -> Column:
        start = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda done, v: F.struct(combine(done["at"], v).alias("at"), F.array_append(done["out"], done["at"]).alias("out"))
        return F.aggregate(some, start, step, lambda done: done["out"])

    def joined(blocks: Column) -> Column:
        firsts = fold(F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), combine)), begin)
        return F.flatten(F.zip_with(blocks, firsts, fold))

    return _bound(values, lambda bound: _bound(_blocks(bound), joined))


def _sum(a: Column, b: Column) -> Column:
    return a + b


def _found(text: Column, pattern: str, kind: int, accept, group: int = 0, offset: Column | None = None) -> Column:
    """The spans of a pattern's matches, left to right without overlap, that `accept` (of the group's string) lets pass."""
    pieces = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    sized = F.zip_with(pieces, matches, lambda p, m: F.struct(F.length(p).alias("p"), F.length(m).alias("m")))
    parts = F.zip_with(sized, values, lambda s, v: F.struct(s["p"].alias("p"), s["m"].alias("m"), v.alias("v")))

    def spans(parts: Column) -> Column:
        begin = F.lit(0) if offset is None else offset
        # there is a piece more than matches: its place in the arrays is filled with nulls
        some = F.filter(parts, lambda part: part["m"].isNotNull())
        before = _running(F.transform(some, lambda part: part["p"] + part["m"]), begin, _sum)

        def span(part: Column, at: Column) -> Column:
            start = at + part["p"]
            return F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + part["m"]).alias("end"), accept(part["v"]).alias("ok"))

        kept = F.filter(F.zip_with(some, before, span), lambda x: x["ok"])
        return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))

    return _bound(parts, spans).cast(SPAN)


def _none() -> Column:
    return F.array().cast(SPAN)


def rule_spans(text: Column) -> list[Column]:
    """The spans of the three rules, each only looked for in texts that can have it."""
    assign = F.when(
        F.contains(text, F.lit("=")) | F.contains(text, F.lit(":")),
        _found(text, ASSIGN, 0, lambda v: F.length(v) >= LEAST_VALUE, 1),
    ).otherwise(_none())
    access = F.when(F.contains(text, F.lit("AKIA")), _found(text, ACCESS, 1, lambda v: F.length(v) >= LEAST_ACCESS)).otherwise(_none())
    hexes = F.when(text.rlike("[0-9a-f]{32}"), _found(text, HEX, 2, lambda v: F.lit(True))).otherwise(_none())
    return [assign, access, hexes]


def _pairs(token: Column) -> Column:
    """The places in the table of a token's neighbouring characters, which must be of the alphabet."""
    codes = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    n = F.size(codes)
    return F.zip_with(F.slice(codes, F.lit(1), n - 1), F.slice(codes, F.lit(2), n - 1), lambda a, b: a * len(ALPHABET) + b)


def labelled_samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = TRAINING_TEXTS) -> DataFrame:
    """Labelled tokens (`token`, `random`): random are the values that the rules find in all texts sampled, and digests of the ids
    as hexadecimal and base 64; ordinary are the words of texts in which no rule finds anything, alone and joined to names as programs have them.

    The sample holds about `most` texts, chosen by the hash of the id.
    """
    share = max(1, -(-docs.count() // most))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    chosen = rows.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0)
    digest = F.sha2(F.coalesce(F.col("id").cast("string"), F.lit("")), 256)
    words = F.regexp_extract_all("text", F.lit("[A-Za-z][A-Za-z0-9_-]{2,}"), F.lit(0))
    marked = chosen.select(
        "text", F.flatten(F.array(*rule_spans(F.col("text")))).alias("spans"), digest.alias("digest"), words.alias("words")
    )
    values = F.transform("spans", lambda s: F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"]))
    last = F.transform(values, lambda v: F.regexp_extract(v, r"([A-Za-z0-9+/=_-]+)$", 1))  # of an assignment, its value
    random = F.concat(last, F.array("digest", F.base64(F.unhex("digest"))))
    # names in programs are words too: two in a row, set apart by a sign or a capital, some with a year or a number
    signs = F.array(*map(F.lit, ("_", "-", "", "/", "_", "=")))
    names = F.transform("words", lambda w, k: F.concat(
        w, F.get(signs, k % 6), F.coalesce(F.when(k % 6 == 2, F.initcap(F.get("words", k + 1))).otherwise(F.get("words", k + 1)), F.lit("")),
        F.when(k % 5 == 0, F.concat(F.get(signs, k % 3), (k * 37 % 2100).cast("string"))).otherwise(F.lit("")),
    ))
    ordinary = F.when(F.size("spans") == 0, F.concat("words", names)).otherwise(F.array().cast("array<string>"))
    return marked.select(F.explode(F.concat(
        F.transform(random, lambda t: F.struct(t.alias("token"), F.lit(True).alias("random"))),
        F.transform(ordinary, lambda t: F.struct(t.alias("token"), F.lit(False).alias("random"))),
    )).alias("x")).select("x.*")


def train(samples: DataFrame) -> list[float]:
    """The table of log-likelihood ratios of character pairs from tokens labelled `random` or not.

    Null tokens and labels and tokens of other characters are left out; without samples all ratios are 0. What comes to the driver is at most
    two counts for each pair of the alphabet.
    """
    size = len(ALPHABET)
    usable = samples.where(F.col("token").rlike(r"^[A-Za-z0-9+/=_-]{2,}$") & F.col("random").isNotNull())
    counts = usable.select("random", F.explode(_pairs(F.col("token"))).alias("pair")).groupBy("random", "pair").count().collect()
    tables = {True: [0.0] * size**2, False: [0.0] * size**2}
    for random, pair, n in counts:
        tables[random][pair] += n

    def logs(table: list[float]) -> list[float]:
        rows = [sum(table[k * size : (k + 1) * size]) for k in range(size)]
        total = sum(rows)
        second = [(sum(table[k::size]) + 1) / (total + size) for k in range(size)]
        return [math.log((x + BACKING * second[k % size]) / (rows[k // size] + BACKING)) for k, x in enumerate(table)]

    return [round(a - b, 5) for a, b in zip(logs(tables[True]), logs(tables[False]))]


def _is_random(token: Column, table: Column) -> Column:
    letter = lambda code: code < LETTERS
    size = len(ALPHABET)
    summed = lambda pairs: F.aggregate(pairs, F.lit(0.0), lambda total, pair: total + F.get(table, pair))
    ratio = summed(_pairs(token))

    def unlike_words(t: Column) -> Column:
        pairs = F.filter(_pairs(t), lambda pair: letter(F.floor(pair / size)) & letter(pair % size))
        return summed(pairs) >= F.greatest(F.lit(LEAST_RATIO_LETTERS), LEAST_MEAN_LETTERS * F.size(pairs))

    return (
        F.when(~token.rlike("[A-Za-z]"), F.lit(False))  # numbers
        .when(token.rlike("[0-9]"), (ratio >= LEAST_RATIO) & (ratio >= LEAST_MEAN * (F.length(token) - 1)))
        .otherwise(unlike_words(token) & unlike_words(F.lower(token)))
    )


def _between(text: Column, pattern: str, find, offset: Column) -> Column:
    """The spans that `find` (of a piece and its place) gives in what lies between a pattern's matches."""
    pieces = F.split(text, pattern, -1)
    matches = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    parts = F.zip_with(pieces, matches, lambda p, m: F.struct(p.alias("piece"), (F.length(p) + F.coalesce(m, F.lit(0))).alias("long")))

    def spans(parts: Column) -> Column:
        before = _running(F.transform(parts, lambda part: part["long"]), offset, _sum)
        return F.flatten(F.zip_with(parts, before, lambda part, at: find(part["piece"], at)))

    return _bound(parts, spans)


def random_spans(text: Column, table: list[float]) -> Column:
    """Spans of tokens that the models call random, outside what the rules have matched."""
    weights = F.split(F.lit(",".join(map(str, table))), ",").cast("array<double>")
    found = lambda part, at: _found(part, TOKEN, 3, lambda v: _is_random(v, weights), offset=at)
    cut = lambda part, at: F.when(part.rlike(RULED), _between(part, RULED, found, at)).otherwise(found(part, at))
    apart = _between(text, ASSIGN, cut, F.lit(0))
    assigns = F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))
    return F.when(~text.rlike(TOKEN), _none()).when(assigns, apart).otherwise(cut(text, F.lit(0)))


def secret_spans(docs: DataFrame, table: list[float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: the id and the spans by kind, `assign`, `access`, `hex` and `random`, in code points, end exclusive.

    Row by row, without a shuffle. A null text is empty and has no spans; repeated rows and null ids are kept as they are; other
    columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    spans = [*rule_spans(text), random_spans(text, table)]
    return docs.select(F.col(id_col), *[s.alias(f"{kind}_spans") for kind, s in zip(KINDS, spans)])


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined, by start, then kind."""
    name = F.array(*map(F.lit, KINDS))
    shown = F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(shown, ",")


def scan(docs: DataFrame, table: list[float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the rules' spans, the digest of their list, and the list of all spans, per row."""
    found = secret_spans(docs, table, id_col, text_col)
    base = F.concat("assign_spans", "access_spans", "hex_spans")
    return found.select(
        F.col(id_col), F.size("assign_spans").cast("long").alias("n_assign"), F.size("access_spans").cast("long").alias("n_access"),
        F.size("hex_spans").cast("long").alias("n_hex"), F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.concat(base, "random_spans")).alias("spans"), F.size("random_spans").cast("long").alias("n_random"),
    )


def redact(docs: DataFrame, table: list[float], text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns with every secret in the text replaced by `mark`. Overlapping spans become one mark; a null
    text stays null."""
    text = F.col(text_col).cast("string")
    whole = F.coalesce(text, F.lit(""))
    spans = F.array_sort(F.concat(*rule_spans(whole), random_spans(whole, table)))

    def masked(spans: Column) -> Column:
        before = _running(F.transform(spans, lambda span: span["end"]), F.lit(0), lambda a, b: F.greatest(a, b))
        placed = F.zip_with(spans, before, lambda span, at: F.struct(span["start"].alias("start"), span["end"].alias("end"), at.alias("at")))
        done = F.aggregate(spans, F.lit(0), lambda a, span: F.greatest(a, span["end"]))

        def cut(block: Column) -> Column:
            # a block's stretch of the text is taken once: a place in a text is found by reading up to it
            first = F.coalesce(F.get(block, F.lit(0))["at"], F.lit(0))
            upto = F.aggregate(block, first, lambda a, x: F.greatest(a, x["end"]))

            def joined(part: Column) -> Column:
                gap = lambda x: F.substring(part["text"], x["at"] - part["first"] + 1, F.greatest(x["start"] - x["at"], F.lit(0)))
                apart = F.filter(block, lambda x: x["start"] >= x["at"])
                return F.array_join(F.transform(apart, lambda x: F.concat(gap(x), F.lit(mark))), "")

            return _bound(F.struct(first.alias("first"), F.substring(whole, first + 1, upto - first).alias("text")), joined)

        parts = _bound(placed, lambda bound: F.array_join(F.transform(_blocks(bound), cut), ""))
        return F.concat(parts, F.substring(whole, done + 1, F.length(whole)))

    clean = _bound(spans, masked)
    columns = [F.when(text.isNotNull(), clean).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return docs.select(*columns)
