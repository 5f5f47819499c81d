"""Main text of web pages: blocks from the markup, and a suffix array over a host's pages that finds what they repeat.

A page's visible text is cut into blocks, each with what the markup says of it: inside the article, inside what is never
article (menus, headers, footers, sidebars, notices, adverts, forms, comments), or neither. The suffixes of a host's token streams
are told apart to the depth of the shortest run that counts, by 64-bit keys of the host and the run; runs that start suffixes of
several distinct pages are boilerplate, however large the host. Blocks covered by such runs go and unique ones stay. Where the markup
names an article its blocks are the text, repeated or not: an article may be printed twice.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlytics.llm import storage

RUN = 8  # tokens, a block's end being one
LEAST_PAGES = 3
MOST_COVERED = 0.5
#: Pages and characters of text whose runs are counted together before they are dealt, and looked up together, at most.
CHUNK_PAGES, CHUNK_BYTES = 4096, 16 << 20
#: Characters of text whose runs one group counts, on average, and the least number of groups.
GROUP_CHARS, LEAST_GROUPS = 16 << 20, 256
#: First bits of a key that are counted first, besides as many as the number of characters has.
FIRST_BITS = 2
#: Weights of pages that are sent to all tasks at most; beyond it they are read chunk by chunk.
MOST_SENT = 50_000

# Names of HTML elements and of their usual classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NEVER = frozenset(
    "script style noscript template head title nav footer aside form button select option textarea iframe svg canvas dialog menu object".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - {"br", "body", "html", "caption", "option", "optgroup", "tbody", "td", "tfoot", "th", "thead", "tr", "legend"}
CHROME = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "disqus footer masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted related "
    "respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|"""
    r"""<(/?)([a-zA-Z][^\s/>]*+)([^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+)>|</?[a-zA-Z][^>]*(?:>|\Z)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")

MAIN, LOOSE, OTHER = 0, 1, 2


def _is_chrome(attributes: str) -> bool:
    if "=" not in attributes and "hidden" not in attributes:
        return False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id") and not CHROME.isdisjoint(re.split(r"[^a-z0-9]+", value)):
            return True
        if name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def blocks(page: str) -> list[tuple[str, int]]:
    """The text blocks of a page in order, each with MAIN, LOOSE or OTHER. Broken and cut markup is read as far as it goes."""
    out: list[tuple[str, int]] = []
    pieces: list[str] = []
    stack: list[tuple[str, int, bool]] = []  # open elements: name, what their text is, whether inside an article
    opened: dict[str, int] = {}  # how many of each name are open
    kind, article = LOOSE, False

    def flush() -> None:
        text = " ".join("".join(pieces).split())
        pieces.clear()
        if text:
            out.append((text, kind))

    def close(depth: int) -> None:
        nonlocal kind, article
        flush()
        _, kind, article = stack[depth]
        for gone, _, _ in stack[depth:]:
            opened[gone] -= 1
        del stack[depth:]

    def innermost(name: str) -> int | None:
        return next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name) if opened.get(name) else None

    at, n = 0, len(page)
    while at < n:
        found = TAG.search(page, at)
        to = found.start() if found else n
        if to > at:
            pieces.append(html.unescape(page[at:to]))
        if not found:
            break
        at = found.end()
        if found.group(0).startswith("<![CDATA["):
            pieces.append(found.group(0)[9:].removesuffix("]]>"))
        name = (found.group(2) or "").lower()
        if not name:
            continue
        if found.group(1):
            depth = innermost(name)
            if depth is not None and (name in BLOCKS or name in NEVER or stack[depth][1:] != (kind, article)):
                close(depth)
            elif depth is not None:
                del stack[depth]
                opened[name] -= 1
            elif name in BLOCKS:
                flush()
            continue
        attributes = found.group(3)
        if name in CLOSES_P:
            depth = innermost("p")
            if depth is not None:
                close(depth)
        if name in BLOCKS or name in NEVER:
            flush()
        if name in RAW and name not in VOID:
            end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if name in VOID or attributes.rstrip().endswith("/") and name not in BLOCKS and name not in NEVER:
            continue
        before = (name, kind, article)
        if kind != OTHER:
            if name in ("article", "main") or 'role="main"' in attributes.lower():
                flush()
                kind, article = MAIN, True
            if name in NEVER or name == "header" and not article or name not in ("body", "html", "article", "main") and _is_chrome(attributes):
                flush()
                kind = OTHER
        stack.append(before)
        opened[name] = opened.get(name, 0) + 1
    flush()
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit numbers, well mixed, one to one."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_keys(tokens: np.ndarray) -> np.ndarray:
    """The key of the run of RUN tokens that starts at each token; the last ones start none."""
    n = max(len(tokens) - RUN + 1, 0)
    keys = np.zeros(n, np.uint64)
    for k in range(RUN):
        keys = _mixed(keys ^ tokens[k : k + n])
    return keys


def _counted(keys: np.ndarray, page: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, in order, and the weights of the distinct pages that have it. The pages are in order."""
    order = np.argsort(keys, kind="stable")
    keys, page = keys[order], page[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    first = new.copy()
    first[1:] |= page[1:] != page[:-1]
    total = np.bincount(np.cumsum(new) - 1, first * weight[page]) if len(keys) else np.zeros(0)
    return keys[new], total.astype(np.int64)


def _within(keys: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which of the keys are among some, which are in order."""
    if not len(some):
        return np.zeros(len(keys), bool)
    return some[np.minimum(np.searchsorted(some, keys), len(some) - 1)] == keys


def _covered(starts: np.ndarray, n: int) -> np.ndarray:
    """Which of n tokens lie in runs that begin at the distinct places `starts`."""
    cover = np.zeros(n + RUN, np.int64)
    cover[starts] += 1
    cover[starts + RUN] -= 1
    return np.cumsum(cover)[:n] > 0


def repeated_runs(tokens: np.ndarray, page: np.ndarray, pages: int) -> np.ndarray:
    """Which tokens lie in a run of RUN tokens that begins suffixes of several distinct pages.

    `tokens` are the codes of the pages' streams end to end, each page's last one its own, so that no run spans two pages.
    """
    keys = run_keys(tokens.astype(np.uint64))
    distinct, n = _counted(keys, page, np.ones(pages, np.int64))
    return _covered(np.flatnonzero(_within(keys, distinct[n >= min(LEAST_PAGES, max(pages, 2))])), len(tokens))


def _streams(texts: list[str], hosts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The token streams of pages end to end: which tokens are blocks' ends and the page of each; then where runs start, and their keys."""
    words: list[str] = []
    sizes = []
    for text in texts:
        own = [*text.replace("\n", " \n ").split(" "), "\n"] if text else []
        words += own
        sizes.append(len(own))
    codes, distinct = pd.factorize(np.array(words, object))
    tokens = pd.util.hash_array(np.asarray(distinct, object), categorize=False)[codes] if words else np.zeros(0, np.uint64)
    page = np.repeat(np.arange(len(texts)), sizes)
    ends = (codes == distinct.tolist().index("\n")) if words else np.zeros(0, bool)
    keys = run_keys(tokens)
    starts = np.flatnonzero(page[: len(keys)] == page[len(page) - len(keys) :])
    return ends, page, starts, _mixed(keys[starts] ^ hosts[page[starts]])


def _to_bytes(keys: np.ndarray) -> bytes:
    """Keys in order as differences, byte by byte of all of them, so that the high bytes compress."""
    return zlib.compress(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _from_bytes(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1).T).view(np.uint64).ravel())


def _parsed(batches):
    """Pages with their blocks and kinds, their place in a chunk, and a digest of their token stream."""
    import pyarrow as pa

    chunk, at, size = 0, 0, 0
    for batch in batches:
        texts, kinds, chunks, places, digests = [], [], [], [], []
        for page, partition in zip(batch["html"].to_pylist(), batch["partition"].to_pylist()):
            found = blocks(page)
            texts.append("\n".join(text for text, _ in found))
            kinds.append("".join(str(kind) for _, kind in found))
            if at >= CHUNK_PAGES or size >= CHUNK_BYTES:
                chunk, at, size = chunk + 1, 0, 0
            chunks.append((partition << 32) + chunk)
            places.append(at)
            digests.append(hashlib.blake2b(texts[-1].encode(), digest_size=16).digest())
            at, size = at + 1, size + len(texts[-1])
        columns = {"id": batch["id"], "url": batch["url"], "host": batch["host"]} | {
            "chunk": pa.array(chunks, pa.int64()), "at": pa.array(places, pa.int64()), "digest": pa.array(digests, pa.binary()),
            "blocks": pa.array(texts, pa.string()), "kinds": pa.array(kinds, pa.string()),
        }
        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _by_chunk(batches):
    """The rows of batches, cut where the chunk changes."""
    for batch in batches:
        chunk = np.array(batch["chunk"].to_pylist(), np.int64)
        cuts = [0, *(np.flatnonzero(chunk[1:] != chunk[:-1]) + 1).tolist(), len(chunk)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield int(chunk[a]), batch.slice(a, b - a)


def _hosts(batch) -> np.ndarray:
    return np.array(batch["host"].to_pylist(), np.int64).view(np.uint64)


def _chunk_file(folder: str, chunk: int) -> list[dict]:
    """The rows that were written for a chunk."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    files, at = storage.filesystem(f"{folder}/chunk={chunk}")
    found = files.get_file_info(fs.FileSelector(at, allow_not_found=True))
    return [row for x in found if x.path.endswith(".parquet") for row in pq.ParquetFile(files.open_input_file(x.path)).read().to_pylist()]


def _written_by_chunk(df: DataFrame, name: str) -> str:
    folder = storage.new_folder(df.sparkSession, name)
    df.repartition("chunk").write.partitionBy("chunk").parquet(folder)
    return folder


def _chunk_keys(folder: str, chunk: int) -> np.ndarray:
    return np.sort(np.concatenate([np.zeros(0, np.uint64), *(_from_bytes(r["keys"]) for r in _chunk_file(folder, chunk))]))


def _sender(groups: int, shift: int, likely: str | None, sent: dict[int, list[tuple[int, int]]] | None, folder: str | None):
    """A function that counts the runs of each chunk's pages and deals them, by ranges of their keys, to groups.

    Without `likely` keys go without their `shift` last bits, which takes less room; with it, whole, and only those whose first bits are in it.
    """
    limits = np.array([-(-(k << 64) // groups) >> (0 if likely else shift) for k in range(1, groups)], np.uint64)

    def flushed(chunk: int, parts: list[tuple[np.ndarray, np.ndarray]]):
        import pyarrow as pa

        keys, weight = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(keys, kind="stable")
        keys, weight = keys[order], weight[order]
        new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        if not len(new):
            return
        keys, weight = keys[new], np.minimum(np.add.reduceat(weight, new), LEAST_PAGES).astype(np.uint8)
        cuts = [0, *np.searchsorted(keys, limits).tolist(), len(keys)]
        some = [(k, a, b) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
        yield pa.RecordBatch.from_arrays([
            pa.array([k for k, _, _ in some], pa.int32()), pa.array([chunk] * len(some), pa.int64()),
            pa.array([_to_bytes(keys[a:b]) for _, a, b in some], pa.binary()), pa.array([weight[a:b].tobytes() for _, a, b in some], pa.binary()),
        ], ["group", "chunk", "keys", "weights"])

    def send(batches):
        now, parts, weights, some = None, [], {}, None
        for chunk, batch in _by_chunk(batches):
            if chunk != now:
                if parts:
                    yield from flushed(now, parts)
                now, parts = chunk, []
                weights = dict(sent.get(chunk, [])) if sent is not None else {r["at"]: r["weight"] for r in _chunk_file(folder, chunk)}
                some = _chunk_keys(likely, chunk) if likely else None
            weight = np.array([weights.get(at, 1) for at in batch["at"].to_pylist()], np.int64)
            _, page, starts, keys = _streams(batch["blocks"].to_pylist(), _hosts(batch))
            first, page = keys >> np.uint64(shift), page[starts]
            if some is None:
                parts.append(_counted(first, page, weight))
            else:
                may = _within(first, some)
                parts.append(_counted(keys[may], page[may], weight))
        if parts:
            yield from flushed(now, parts)

    return send


def _repeated(frame: pd.DataFrame) -> pd.DataFrame:
    """For each chunk, those of its runs in a group that all chunks together have on enough pages."""
    own = [_from_bytes(x) for x in frame["keys"]]
    keys = np.concatenate(own)
    weight = np.concatenate([np.frombuffer(x, np.uint8) for x in frame["weights"]])
    order = np.argsort(keys, kind="stable")
    keys, weight = keys[order], weight[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    repeated = keys[new][np.add.reduceat(weight.astype(np.int64), new) >= LEAST_PAGES]
    found = [(chunk, x[_within(x, repeated)]) for chunk, x in zip(frame["chunk"], own)]
    some = [(chunk, _to_bytes(x)) for chunk, x in found if len(x)]
    return pd.DataFrame({"chunk": np.array([c for c, _ in some], np.int64), "keys": [x for _, x in some]})


def _reader(folder: str):
    """A function that gives the main texts of pages from their blocks and their chunk's repeated runs."""

    def read(batches):
        import pyarrow as pa

        now, repeated = None, np.zeros(0, np.uint64)
        for chunk, batch in _by_chunk(batches):
            if chunk != now:
                now, repeated = chunk, _chunk_keys(folder, chunk)
            texts = batch["blocks"].to_pylist()
            ends, _, starts, keys = _streams(texts, _hosts(batch))
            covered = _covered(starts[_within(keys, repeated)], len(ends))
            block = np.cumsum(ends) - ends
            share = np.bincount(block, covered) / np.bincount(block) if len(block) else np.zeros(0)
            boiler = (share > MOST_COVERED).tolist()
            out, n_repeated, b = [], [], 0
            for text, kinds in zip(texts, batch["kinds"].to_pylist()):
                found = list(zip(text.split("\n"), map(int, kinds), boiler[b : b + len(kinds)]))
                b += len(kinds)
                marked = any(kind == MAIN for _, kind, _ in found)
                out.append("\n".join(x for x, kind, gone in found if kind == MAIN or kind == LOOSE and not marked and not gone))
                n_repeated.append(sum(len(x) for x, _, gone in found if gone))
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["url"], pa.array(out, pa.string()), pa.array(n_repeated, pa.int64())], ["id", "url", "text", "n_repeated"]
            )

    return read


def host(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


def _weights(parsed: DataFrame) -> DataFrame:
    """Chunk, place and weight of the pages whose weight in the count is not 1: none for all but the first page of a host with the same token
    stream, two for both of a host that has but two, where a run on both counts."""
    firsts = parsed.groupBy("host", "digest").agg(F.min(F.struct("chunk", "at")).alias("first")).select("host", "first.*")
    copies = parsed.select("chunk", "at").join(firsts, ["chunk", "at"], "left_anti").withColumn("weight", F.lit(0))
    place = F.struct("chunk", "at")
    hosts = firsts.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("a"), F.max(place).alias("b"))
    pairs = hosts.where("n = 2").select(F.explode(F.array("a", "b")).alias("x")).select("x.*", F.lit(2).alias("weight"))
    return copies.unionByName(pairs)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text (blocks joined by a line feed, empty if there are none), n_chars (code points), and n_repeated,
    the characters of blocks that the host's pages repeat.

    Pages are read once and their blocks staged. Each chunk of pages sends the keys of its runs, each once, to groups by ranges of the
    keys; these count the pages of a whole host and tell each chunk which of its runs are repeated: once by the keys' first bits, which leaves
    out most runs that are not, then by whole keys. So a host of any size is spread, and no task holds more than a chunk or a group. Pages of one token stream count once. Null pages are empty; null urls are one host;
    null ids and repeated rows are kept; only the three named columns are read.
    """
    spark = pages.sparkSession
    storage.bound_batches(spark)
    url, kind = F.col(url_col).cast("string"), dict(pages.dtypes)[id_col]
    rows = pages.select(
        F.col(id_col).alias("id"), url.alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"),
        F.xxhash64(host(url)).alias("host"), F.spark_partition_id().cast("long").alias("partition"),
    )
    schema = f"id {kind}, url string, host long, chunk long, at long, digest binary, blocks string, kinds string"
    parsed = storage.staged(rows.mapInArrow(_parsed, schema), "blocks")
    weights = storage.staged(_weights(parsed), "weights")
    sent, folder = None, None
    if weights.count() <= MOST_SENT:
        sent = {}
        for chunk, at, weight in weights.collect():
            sent.setdefault(chunk, []).append((at, weight))
    else:
        folder = _written_by_chunk(weights, "weights")
    chars = parsed.agg(F.sum(F.length("blocks"))).first()[0] or 0
    groups = max(LEAST_GROUPS, -(-chars // GROUP_CHARS))
    shift, repeated = max(0, 64 - FIRST_BITS - int(chars).bit_length()), None
    for name in ("likely", "repeated"):
        runs = parsed.select("chunk", "at", "host", "blocks").mapInArrow(
            _sender(groups, shift, repeated, sent, folder), "group int, chunk long, keys binary, weights binary"
        )
        repeated = _written_by_chunk(runs.groupBy("group").applyInPandas(_repeated, "chunk long, keys binary"), name)
    texts = parsed.select("id", "url", "chunk", "host", "blocks", "kinds").mapInArrow(
        _reader(repeated), f"id {kind}, url string, text string, n_repeated long"
    )
    return texts.select(
        F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"), "n_repeated"
    )
