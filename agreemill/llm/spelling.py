"""Spelling variants: a trie self-join with active-node sets at distance one.

A vocabulary is counted on Spark, then near words (one code point inserted,
deleted or replaced) are found in tries. Two near words share all before their
first difference and all after the edit, so for any place in the shorter word
they share either the part before it or the part after it. Each word is
dealt to groups by the length of the shorter word, a range of places for the
first difference, and the shared part outside that range: the prefix of a trie,
or the suffix. At first a word's places are cut in half. A group of too many
letters has its range cut again until it is small, down to a single place, where
a group holds at most the combinations of two letters; every pair lies in the
one group that its first difference names, so nothing is found twice or lost.

In a task, groups are the prefix partitions of one trie, built in arrays. Its
active-node sets go down one level at a time: at distance zero a node is active
for itself only; at distance one, a pair of nodes arises from two children of a
node (replaced) or from a node and its child (inserted), and moves on to pairs
of children by equal letters. Terminal pairs are emitted.

Edge cases. Null texts have no words; a null id counts as empty text. Repeated
rows count as often as they stand. Ties between forms go to the smaller word in
code-point order. Words may have any length and any letters. Empty tables give
empty results. Extra columns of any name are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agreemill.llm.common import checkpoint, col, fresh, small_batches, table

MIN_LENGTH = 7
MIN_TIMES = 2
#: A form is at least so many times as frequent as its variant.
RATIO = 10
#: One run in so many loses a letter.
TYPO = 31
#: Letters of a group, and of the tries that a task builds at a time.
GROUP_LETTERS = 100_000
CHUNK_LETTERS = 100_000
MAX_ROUNDS = 64
ROWS_A_FILE = 200_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


_NONE = np.zeros(0, np.int64)
_EMPTY = {"word": _NONE, "parent": _NONE, "letter": _NONE, "keys": _NONE, "starts": _NONE, "ends": _NONE}


def _matrix(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points (from 1; 0 beyond a word's end) and lengths."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.zeros((len(words), int(lengths.max(initial=0)) + 1), np.int64)
    letters[np.arange(letters.shape[1]) < lengths[:, None]] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
    return letters, lengths


def _shared(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """How many letters two rows share from the start; all if they are equal."""
    differ = one != two
    return np.where(differ.any(1), differ.argmax(1), differ.shape[1])


def trie(groups: np.ndarray, letters: np.ndarray, lengths: np.ndarray) -> list[dict[str, np.ndarray]]:
    """The levels of a trie with one root a group, of rows sorted by group and
    word. A node has the row that ends there (-1: none), its parent, its letter,
    and the range of its children in the next level; ``keys`` orders a level by
    parent and letter."""
    first = np.ones(len(groups), bool)
    first[1:] = groups[1:] != groups[:-1]
    same = np.zeros(len(groups), np.int64)
    if len(groups) > 1:
        same[1:] = np.where(first[1:], 0, _shared(letters[1:], letters[:-1]))
    levels: list[dict[str, np.ndarray]] = []
    above = _NONE
    for depth in range(letters.shape[1] + 1):
        new = first if depth == 0 else (lengths >= depth) & ((same < depth) | first)
        heads, ids = np.flatnonzero(new), np.cumsum(new) - 1
        ends_here = np.flatnonzero(lengths == depth)
        word = np.full(len(heads), -1)
        word[ids[ends_here]] = ends_here
        nothing = np.zeros(len(heads), np.int64)
        level = {**_EMPTY, "word": word, "starts": nothing, "ends": nothing}
        if depth:
            level |= {"parent": above[heads], "letter": letters[heads, depth - 1]}
            level["keys"] = (level["parent"] << 21) | level["letter"]
            nodes = np.arange(len(levels[-1]["word"]))
            levels[-1] |= {"starts": np.searchsorted(level["parent"], nodes), "ends": np.searchsorted(level["parent"], nodes, side="right")}
        levels.append(level)
        above = ids
    return levels


def _spread(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each index as often as its size, with a running number in each."""
    index = np.repeat(np.arange(len(sizes)), sizes)
    return index, np.arange(len(index)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _followed(here: dict, down: dict, far: dict, pairs: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of children by equal letters: of nodes in ``here``, with children in
    ``down``, and of their partners, with children in ``far``."""
    u, v = pairs
    pair, k = _spread(here["ends"][u] - here["starts"][u])
    child = here["starts"][u][pair] + k
    wanted = (v[pair] << 21) | down["letter"][child]
    at = np.searchsorted(far["keys"], wanted)
    hit = np.flatnonzero(at < len(far["keys"]))
    hit = hit[far["keys"][at[hit]] == wanted[hit]]
    return child[hit], at[hit]


def terminal_pairs(levels: list[dict[str, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of all rows of one group at edit distance one, each pair once."""
    found: list[tuple[np.ndarray, np.ndarray]] = [(_NONE, _NONE)]

    def emit(a: np.ndarray, b: np.ndarray) -> None:
        good = (a >= 0) & (b >= 0)
        found.append((a[good], b[good]))

    levels = [*levels, _EMPTY, _EMPTY]
    replaced = inserted = (_NONE, _NONE)  # active partners on a node's level, and one below it
    for here, down, below in zip(levels, levels[1:], levels[2:], strict=False):
        own = np.arange(len(down["parent"]))
        both = np.unique(np.concatenate([(inserted[0] << 32) | inserted[1], (down["parent"] << 32) | own]))
        inserted = both >> 32, both & 0xFFFFFFFF
        emit(here["word"][replaced[0]], here["word"][replaced[1]])
        emit(here["word"][inserted[0]], down["word"][inserted[1]])
        left, k = _spread(here["ends"][down["parent"]] - own - 1)
        one, two = _followed(here, down, down, replaced)
        replaced = np.concatenate([one, left]), np.concatenate([two, left + 1 + k])
        inserted = _followed(here, down, below, inserted)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def near_pairs(groups: np.ndarray, shorter: np.ndarray, width: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of the pairs of a group at edit distance one whose shorter word has
    ``shorter`` letters and whose first difference lies under ``width``.

    Rows are distinct and sorted by (group, word).
    """
    letters, lengths = _matrix(words)
    i, j = terminal_pairs(trie(groups, letters, lengths))
    good = (np.minimum(lengths[i], lengths[j]) == shorter[i]) & (_shared(letters[i], letters[j]) < width[i])
    return i[good], j[good]


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", typo: int = TYPO) -> DataFrame:
    """(word, n): runs of Latin letters with A-Z in lower case, of MIN_LENGTH
    letters and MIN_TIMES occurrences at least.

    One run in ``typo``, named by a checksum of the document's id and the run,
    loses the letter that the checksum names.
    """
    pattern = rf"[A-Za-zÀ-ÿ]{{{MIN_LENGTH},}}"
    runs = docs.select(F.coalesce(col(key).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(col(text), F.lit(pattern), F.lit(0))).alias("run"))
    runs = runs.select("id", F.translate("run", _UPPER, _LOWER).alias("run"))
    h, size = F.col("h"), F.length("run")
    at = (h % size).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, size))
    hashed = runs.withColumn("h", F.crc32(F.concat_ws(":", "id", "run")))
    found = hashed.select(F.when(h % typo == 0, cut).otherwise(F.col("run")).alias("word"))
    return found.where(F.length("word") >= MIN_LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_TIMES)


_KEYS = ["l", "lo", "hi", "shared"]


def _dealt(ranged: DataFrame) -> DataFrame:
    """(l, lo, hi, shared, middle, word, n): a word in the group of each of its
    ranges (l, lo, hi): l letters in the shorter word, first difference from lo
    and under hi, the shared part outside, and the rest of the word."""
    tail = F.greatest(F.col("l") - F.col("hi"), F.lit(0))
    size = F.length("word")
    shared = F.concat(F.substring("word", F.lit(1), F.col("lo")), F.substring("word", size - tail + 1, tail))
    return ranged.select("l", "lo", "hi", shared.alias("shared"), F.substring("word", F.col("lo") + 1, size - F.col("lo") - tail).alias("middle"), "word", "n")


def _halved(ranged: DataFrame) -> DataFrame:
    """Every range cut in two."""
    cut = F.col("lo") + F.greatest(F.lit(1), F.expr("(hi - lo) div 2").cast("int"))
    parts = F.array(F.struct("lo", cut.alias("hi")), F.struct(cut.alias("lo"), "hi"))
    return ranged.select("l", F.inline(parts), "word", "n")


def groups(words: DataFrame, letters: int = GROUP_LETTERS) -> DataFrame:
    """The words dealt to groups of at most ``letters`` letters, or of one place."""
    size = F.length("word")
    shorter = F.explode(F.filter(F.array(size, size - 1), lambda x: x > 0)).alias("l")
    ranged = _halved(words.select("word", "n", shorter).select("l", F.lit(0).alias("lo"), (F.col("l") + 1).alias("hi"), "word", "n"))
    done = []
    for _ in range(MAX_ROUNDS):
        now = _dealt(ranged)
        sizes = now.where("hi - lo > 1").groupBy(*_KEYS).agg(F.sum(F.length("middle") + 1).alias("letters"))
        heavy = sizes.where(F.col("letters") > letters).select(*_KEYS)
        if not heavy.head(1):
            done.append(now)
            break
        heavy = checkpoint(heavy)
        done.append(now.join(heavy, _KEYS, "left_anti"))
        ranged = checkpoint(_halved(now.join(heavy, _KEYS, "left_semi").select("l", "lo", "hi", "word", "n")))
    out = done[0]
    for part in done[1:]:
        out = out.union(part)
    return out


def _found(rows: pa.Table) -> pa.Table:
    """The near pairs of whole groups, sorted by group and middle."""
    changed = np.zeros(rows.num_rows, bool)
    for key in _KEYS:
        values = rows[key].combine_chunks()
        changed[1:] |= pc.not_equal(values[1:], values[:-1]).to_numpy(zero_copy_only=False)
    group = np.cumsum(changed)
    several = np.bincount(group)[group] > 1
    rows, group = rows.filter(pa.array(several)), group[several]
    l, lo, hi = (rows[k].to_numpy() for k in _KEYS[:3])
    shorter, middles = l - lo - np.maximum(l - hi, 0), rows["middle"].to_pylist()
    parts = [(_NONE, _NONE)]
    for length in np.unique(l):  # words of about one length fill a matrix well
        a, b = np.searchsorted(l, [length, length + 1])
        i, j = near_pairs(group[a:b], shorter[a:b], (hi - lo)[a:b], middles[a:b])
        parts.append((i + a, j + a))
    i, j = (pa.array(np.concatenate([p[k] for p in parts])) for k in (0, 1))
    return pa.table({"a": rows["word"].take(i), "n_a": rows["n"].take(i), "b": rows["word"].take(j), "n_b": rows["n"].take(j)})


def near_words(words: DataFrame, letters: int = GROUP_LETTERS) -> DataFrame:
    """(a, n_a, b, n_b): all pairs of ``words`` (word, n; distinct) at edit
    distance one, each once."""
    small_batches()
    rows = groups(words, letters)

    def size_of(rows: pa.Table | pa.RecordBatch) -> int:
        return (pc.sum(pc.utf8_length(rows["middle"])).as_py() or 0) + rows.num_rows

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += size_of(batch)
            if size < CHUNK_LETTERS:
                continue
            rows = pa.Table.from_batches(held)
            last = np.ones(rows.num_rows, bool)
            for key in _KEYS:
                last &= pc.equal(rows[key], rows[key][-1]).to_numpy()
            cut = rows.num_rows - int(last.sum())  # the last group may go on
            yield from _found(rows.slice(0, cut)).to_batches()
            held = rows.slice(cut).to_batches()
            size = size_of(rows.slice(cut))
        if held:
            yield from _found(pa.Table.from_batches(held)).to_batches()

    return rows.repartition(*_KEYS).sortWithinPartitions(*_KEYS, "middle").mapInArrow(search, "a string, n_a long, b string, n_b long")


def roots(links: DataFrame, files: int | None = None) -> DataFrame:
    """(word, root): the last form of each chain of (word, form), by doubling.

    Forms are more frequent than their words, so chains end. Each round is
    written in ``files`` files.
    """
    now = checkpoint(links.select("word", F.col("form").alias("root")), files)
    for _ in range(MAX_ROUNDS):
        far = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = checkpoint(now.join(far, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), files)
        now = fresh(step.select("word", "root"))
        if not step.where("moved").head(1):
            return now
    raise RuntimeError(f"chains of forms did not end in {MAX_ROUNDS} doublings")


def variants(words: DataFrame, ratio: int = RATIO, letters: int = GROUP_LETTERS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all ``words`` (word, n; distinct).

    A word's form is its most frequent near word, if that is at least ``ratio``
    times as frequent; the root is the last form reached.
    """
    words = checkpoint(words.select("word", "n"), words.sparkSession.sparkContext.defaultParallelism)
    files = 1 + words.count() // ROWS_A_FILE
    one = F.struct(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("other"), F.col("n_b").alias("m"))
    two = F.struct(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("other"), F.col("n_a").alias("m"))
    best = near_words(words, letters).select(F.inline(F.array(one, two))).groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    form = F.when(-F.col("best.m") >= ratio * F.col("n"), F.struct(F.col("best.other").alias("form"), (-F.col("best.m")).alias("form_n")))
    best = checkpoint(best.select("word", "n_near", form.alias("best")).select("word", "n_near", "best.form", "best.form_n"), files)
    last = roots(best.where("form is not null"), files)
    out = words.join(best, "word", "left").join(last, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def document_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spelling variants among the words of all documents."""
    return variants(vocabulary(table(spark, sf_dir, "documents")))


ORACLE_SQL = rf"""
WITH t AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))
), r AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]{{{MIN_LENGTH},}}')), '{_UPPER}', '{_LOWER}') AS run FROM documents
), b AS (
  SELECT id, run, hex(encode(id || ':' || run)) AS x FROM (SELECT DISTINCT id, run FROM r)
), h AS (
  SELECT id, run, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(x) // 2), lambda i: CAST('0x' || x[2 * i + 1:2 * i + 2] AS BIGINT))),
    lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295::BIGINT) AS h FROM b, t
), w AS (
  SELECT CASE WHEN h % {TYPO} = 0 THEN run[:h % len(run)] || run[h % len(run) + 2:] ELSE run END AS word FROM r JOIN h USING (id, run)
), v AS (
  SELECT word, count(*) AS n FROM w WHERE len(word) >= {MIN_LENGTH} GROUP BY word HAVING count(*) >= {MIN_TIMES}
), d AS (
  SELECT word, n, p, word[:p - 1] || word[p + 1:] AS rest FROM (SELECT word, n, unnest(range(1, len(word) + 1)) AS p FROM v)
), e AS (
  SELECT a.word, b.word AS other, b.n AS m FROM d a JOIN d b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
  UNION SELECT v.word, d.word, d.n FROM v JOIN d ON v.word = d.rest UNION SELECT d.word, v.word, v.n FROM v JOIN d ON v.word = d.rest
), s AS (
  SELECT v.word, v.n, count(other) AS n_near, min(struct_pack(m := -m, other := other)) FILTER (WHERE other IS NOT NULL) AS best FROM v LEFT JOIN e USING (word) GROUP BY v.word, v.n
), f AS (
  SELECT word, n, n_near, CASE WHEN -best.m >= {RATIO} * n THEN best.other END AS form, CASE WHEN -best.m >= {RATIO} * n THEN -best.m END AS form_n FROM s
), c AS (
  WITH RECURSIVE c AS (SELECT word, word AS root FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL)
  SELECT c.word, c.root FROM c JOIN f ON f.word = c.root WHERE f.form IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM f JOIN c USING (word)
"""
