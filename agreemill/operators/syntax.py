"""Subject stripping and prompt strata over parsed tokens.

The parser is the caller's: its output is a token table (doc_id, i, text, ws,
lower, lemma, pos, dep, head). Rules are DataFrame functions over one row a
document with its tokens in order. Where a subtree begins and ends is found once
for all tokens, from the leaves up and at any depth; it then is one look-up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agreemill import plugins

#: Dependency labels and word lists.
PRE_MODIFIERS = ("det", "predet", "poss", "nummod", "quantmod", "amod", "compound", "nmod", "nn")
MODIFIERS_OF_LATER = ("amod", "compound", "nmod", "nn")
MEDIUM_NOUNS = ("photo", "photograph", "picture", "image", "painting", "illustration", "sketch", "drawing", "render", "rendering", "art", "artwork", "portrait", "watercolor", "style", "scene", "shot", "close", "view", "poster", "design", "version")
MEDIUM_VERBS = ("style", "render", "depict", "show", "feature", "capture", "inspire", "focus", "emphasize")


def documents(tokens: DataFrame) -> DataFrame:
    """(doc_id, t): tokens of a document as an array in order."""
    fields = ["i", "text", "ws", "lower", "lemma", "pos", "dep", "head"]
    return tokens.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("t"))


def _index(t: Column) -> Column:
    """0 .. n-1, empty for no tokens."""
    return F.slice(F.sequence(F.lit(0), F.size(t)), F.lit(1), F.size(t))


def _hits(t: Column, name: Column) -> Column:
    """Starts of the windows that equal the name by lemmas or by words."""
    n = F.size(name)

    def same(i: Column, field: str) -> Column:
        return F.transform(F.slice(t, i + 1, n), lambda x: F.lower(x[field])) == F.transform(name, lambda x: F.lower(x[field]))

    return F.filter(_index(t), lambda i: (n > 0) & (i + n <= F.size(t)) & (same(i, "lemma") | same(i, "lower")))


def mentions(docs: DataFrame, names: DataFrame) -> DataFrame:
    """Add ``spans``: array of struct(start, end) of the subject's mentions.

    ``names`` is (doc_id, name): the parsed tokens of the subject's name. The
    leftmost windows win where they overlap. A longer name without a match falls
    back on nouns with its root's lemma.
    """
    joined = docs.join(names, "doc_id", "left").withColumn("name", F.coalesce("name", F.expr("slice(t, 1, 0)")))
    n = F.size("name")
    zero = F.struct(F.lit(0).alias("free"), F.expr("cast(array() as array<int>)").alias("kept"))
    step = lambda acc, i: F.when(i >= acc["free"], F.struct((i + n).alias("free"), F.concat(acc["kept"], F.array(i)).alias("kept"))).otherwise(acc)
    starts = F.aggregate(_hits(F.col("t"), F.col("name")), zero, step, lambda acc: acc["kept"])
    root = F.filter("name", lambda x: (x["head"] == x["i"]) | (x["dep"] == "ROOT"))
    lemma = F.lower(F.get(root, F.lit(0))["lemma"])
    nouns = F.filter("t", lambda x: x["pos"].isin("NOUN", "PROPN") & (F.lower(x["lemma"]) == lemma))
    spans = F.transform("starts", lambda i: F.struct(i.alias("start"), (i + n).alias("end")))
    single = F.transform(nouns, lambda x: F.struct(x["i"].cast("int").alias("start"), (x["i"] + 1).cast("int").alias("end")))
    return joined.withColumn("starts", starts).withColumn("spans", F.when((F.size("starts") > 0) | (n <= 1), spans).otherwise(single)).drop("starts")


def _root_of(t: Column, start: Column, end: Column) -> Column:
    """The token of a span whose head lies outside it (or is itself)."""
    inside = F.slice(t, start + 1, end - start)
    return F.coalesce(F.get(F.filter(inside, lambda x: (x["head"] < start) | (x["head"] >= end) | (x["head"] == x["i"])), F.lit(0)), F.get(inside, F.lit(0)))


def edges(heads: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and last token of every token's subtree, for the heads of several
    documents on end (``sizes`` tokens each; both count within the document).

    A root heads itself. Tokens without a head in their document, and tokens in
    a ring of heads or below one, count as roots.
    """
    starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
    n = np.repeat(sizes, sizes)
    own = np.arange(len(heads))
    up = np.where((heads >= 0) & (heads < n), heads + starts, own)
    depth, far = (up != own).astype(np.int64), up.copy()
    for _ in range(int(sizes.max(initial=0)).bit_length()):
        depth, far = depth + depth[far], far[far]
    ring = up[far] != far
    up[ring], depth[ring] = own[ring], 0
    first, last = own.copy(), own.copy()
    order = np.argsort(-depth, kind="stable")
    cuts = np.flatnonzero(np.diff(depth[order])) + 1
    for level in np.split(order, cuts):  # a level's subtrees are whole before the one above
        np.minimum.at(first, up[level], first[level])
        np.maximum.at(last, up[level], last[level])
    return first - starts, last - starts


def with_edges(docs: DataFrame) -> DataFrame:
    """Add ``lefts`` and ``rights``: the first and last token of each token's subtree."""

    @F.arrow_udf("struct<lefts: array<int>, rights: array<int>>")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for heads in batches:
            offsets = heads.offsets.to_numpy()
            found = edges(heads.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), np.diff(offsets))
            at = pa.array(offsets - offsets[0], pa.int32())
            yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32))) for x in found], ["lefts", "rights"])

    heads = F.transform("t", lambda x: x["head"].cast("int"))
    return docs.withColumn("_edges", find(heads)).withColumns({"lefts": F.col("_edges.lefts"), "rights": F.col("_edges.rights")}).drop("_edges")


def _left_reach(t: Column, of: Column, before: Column, strict: bool) -> Column:
    """Leftmost reach of a token's pre-modifiers on its left (else ``before``)."""
    mods = F.filter(t, lambda x: (x["head"] == of) & (x["i"] < of) & x["dep"].isin(*PRE_MODIFIERS))
    if strict:
        mods = F.filter(mods, lambda x: F.get(F.col("rights"), x["i"].cast("int")) < before)
    return F.least(before, F.coalesce(F.array_min(F.transform(mods, lambda x: F.get(F.col("lefts"), x["i"].cast("int")))), before))


def _removed(t: Column, span: Column) -> Column:
    """Token indexes that go with one mention."""
    start, end = span["start"], span["end"]
    head = _root_of(t, start, end)
    right = F.greatest(end, head["i"] + 1).cast("int")
    outer = F.get(t, head["head"].cast("int"))
    own = (outer["i"] == right) & outer["pos"].isin("NOUN", "PROPN") & ~F.endswith(outer["lower"], F.lit("ing"))
    zero = F.struct(head["i"].cast("int").alias("node"), _left_reach(t, head["i"], start, False).cast("int").alias("left"), F.lit(True).alias("on"))

    def climb(acc: Column, _: Column) -> Column:
        node = F.get(t, acc["node"])
        go = acc["on"] & ~own & node["dep"].isin(*MODIFIERS_OF_LATER) & (node["head"] > node["i"])
        up = node["head"].cast("int")
        reach = F.least(acc["left"], _left_reach(t, up, start, True)).cast("int")
        return F.when(go, F.struct(up.alias("node"), reach.alias("left"), F.lit(True).alias("on"))).otherwise(F.struct(acc["node"].alias("node"), acc["left"].alias("left"), F.lit(False).alias("on")))

    left = F.aggregate(t, zero, climb, lambda acc: acc["left"])
    marker = F.transform(F.filter(t, lambda x: (head["dep"] == "poss") & (x["head"] == head["i"]) & (x["i"] > head["i"]) & (x["dep"] == "case")), lambda x: x["i"].cast("int"))
    return F.concat(F.sequence(left, right - 1), marker)


def strip_subjects(docs: DataFrame) -> DataFrame:
    """Add ``stripped``: the text without the mentions (``spans``) and the
    pre-modifiers of their noun phrases, white space collapsed."""
    columns, docs = docs.columns, with_edges(docs)
    t = F.col("t")
    gone = F.flatten(F.transform("spans", lambda s: _removed(t, s)))
    kept = F.filter(t, lambda x: ~F.array_contains(F.col("gone"), x["i"].cast("int")))
    text = F.array_join(F.transform(kept, lambda x: F.concat(x["text"], F.when(x["ws"], F.lit(" ")).otherwise(F.lit("")))), "")
    space = F.regexp_replace(text, r"(?U)\s+", " ")
    tidy = F.regexp_replace(F.trim(F.regexp_replace(space, r"\s+([,.;:!?])", "$1")), r"^[\s,;:]+", "")
    return docs.withColumn("gone", gone).withColumn("stripped", F.when(F.size("spans") > 0, tidy).otherwise(F.trim(space))).select(*columns, "stripped")


def strata(docs: DataFrame, lexical: bool = False) -> DataFrame:
    """Add action_pose, attribute, subject_dependent, scene_only and how the
    subject was found.

    The subject's heads are the roots of its mentions, else the first noun that
    heads a phrase and names no medium. ``lexical``: action is any verb that is
    no medium verb.
    """
    t = F.col("t")
    roots = F.transform("spans", lambda s: _root_of(t, s["start"], s["end"])["i"].cast("int"))
    noun = F.filter(t, lambda x: x["pos"].isin("NOUN", "PROPN", "PRON") & ~x["dep"].isin("compound", "nmod", "nn") & ~F.lower(x["lemma"]).isin(*MEDIUM_NOUNS))
    first = F.transform(F.slice(noun, 1, 1), lambda x: x["i"].cast("int"))
    found = docs.withColumn("heads", F.when(F.size("spans") > 0, roots).otherwise(first))
    words = F.transform("name", lambda x: x["lower"])
    of = lambda x: F.array_contains(F.col("heads"), x["head"].cast("int")) & (x["head"] != x["i"])
    acts = F.exists(t, lambda x: of(x) & x["dep"].isin("acl", "relcl") & x["pos"].isin("VERB", "AUX"))
    subject = F.exists(t, lambda x: F.array_contains(F.col("heads"), x["i"].cast("int")) & x["dep"].isin("nsubj", "nsubjpass") & (F.get(t, x["head"].cast("int"))["pos"] == "VERB"))
    modified = F.exists(t, lambda x: of(x) & ((x["dep"].isin("amod", "compound", "nmod") & (x["i"] < x["head"]) & ~F.array_contains(words, x["lower"])) | ((x["dep"] == "prep") & (x["lower"] == "with"))))
    verbs = F.exists(t, lambda x: (x["pos"] == "VERB") & ~F.lower(x["lemma"]).isin(*MEDIUM_VERBS))
    how = F.when(F.size("spans") > 0, F.lit("mention")).when(F.size("heads") > 0, F.lit("first_noun_chunk")).otherwise(F.lit("none"))
    action = verbs if lexical else (acts | subject)
    out = found.withColumn("action_pose", action).withColumn("attribute", modified).withColumn("subject_found_by", how)
    either = F.col("action_pose") | F.col("attribute")
    return out.withColumn("subject_dependent", either).withColumn("scene_only", ~either).drop("heads")


def stratum(name: str) -> Column:
    """The condition of a named stratum."""
    both = F.col("action_pose") & F.col("attribute")
    known = {"all": F.lit(True), "subject_dependent": F.col("subject_dependent"), "action_pose": F.col("action_pose"), "attribute": F.col("attribute"), "both_action_and_attribute": both, "scene_only": F.col("scene_only")}
    return known[name]


RULES = ("dependency", "lexical")


def labelled(docs: DataFrame, rule: str = "dependency", **options: object) -> DataFrame:
    """Strata by a rule: one of ``RULES``, or a registered strata rule, which gets a
    document's words, pos, dep and the starts of its mentions, and returns
    action_pose and attribute."""
    if rule in RULES:
        return strata(docs, lexical=rule == "lexical")
    schema = "doc_id string, action_pose boolean, attribute boolean"
    asked = docs.select("doc_id", F.transform("t", lambda x: x["text"]).alias("words"), F.transform("t", lambda x: x["pos"]).alias("pos"), F.transform("t", lambda x: x["dep"]).alias("dep"), F.transform("spans", lambda s: s["start"]).alias("starts"))
    found = plugins.apply(asked, "strata_rule", rule, ["doc_id"], schema, **options)
    either = F.col("action_pose") | F.col("attribute")
    return docs.join(found, "doc_id").withColumn("subject_dependent", either).withColumn("scene_only", ~either)
