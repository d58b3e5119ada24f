"""A small hand-parsed token table, in the shape a parser would deliver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agreemill.schema import TOKEN, struct

#: text/lemma/pos/dep/head, one line a document; an underscore before a slash
#: means that no space follows. Names come after the bar.
PARSES = {
    "d1": "A/a/DET/det/1 painting/painting/NOUN/ROOT/1 of/of/ADP/prep/1 a/a/DET/det/7 tall_/tall/ADJ/amod/7 ,/,/PUNCT/punct/7 crooked/crooked/ADJ/amod/7 lantern/lantern/NOUN/pobj/2 guarding/guard/VERB/acl/7 a/a/DET/det/10 doorway_/doorway/NOUN/dobj/8|lantern/lantern/NOUN/ROOT/0",
    "d2": "The/the/DET/det/1 fox_/fox/NOUN/poss/3 's/'s/PART/case/1 den/den/NOUN/nsubj/4 sits/sit/VERB/ROOT/4 under/under/ADP/prep/4 an/an/DET/det/7 oak_/oak/NOUN/pobj/5|fox/fox/NOUN/ROOT/0",
    "d3": "a/a/DET/det/2 heron/heron/NOUN/compound/2 fishing/fishing/NOUN/ROOT/2 in/in/ADP/prep/2 the/the/DET/det/5 reeds_/reed/NOUN/pobj/3|heron/heron/NOUN/ROOT/0",
    "d4": "A/a/DET/det/1 picture/picture/NOUN/ROOT/1 of/of/ADP/prep/1 two/two/NUM/nummod/5 garden/garden/NOUN/compound/5 gnomes/gnome/NOUN/pobj/2 by/by/ADP/prep/1 a/a/DET/det/8 fence_/fence/NOUN/pobj/6|garden/garden/NOUN/compound/1 gnome/gnome/NOUN/ROOT/1",
    "d5": "a/a/DET/det/2 canoe/canoe/NOUN/compound/2 paddler/paddler/NOUN/nsubj/3 rests/rest/VERB/ROOT/3 beside/beside/ADP/prep/3 the/the/DET/det/6 jetty_/jetty/NOUN/pobj/4|canoe/canoe/NOUN/ROOT/0",
    "d6": "A/a/DET/det/2 blue/blue/ADJ/amod/2 door/door/NOUN/ROOT/2 with/with/ADP/prep/2 ivy_/ivy/NOUN/pobj/3|goat/goat/NOUN/ROOT/0",
    "d7": "A/a/DET/det/1 painting_/painting/NOUN/ROOT/1|",
    "d8": "The/the/DET/det/1 owl/owl/NOUN/nsubj/2 blinks_/blink/VERB/ROOT/2 ,/,/PUNCT/punct/2 an/an/DET/det/5 owl/owl/NOUN/nsubj/6 styled/style/VERB/conj/2|owl/owl/NOUN/ROOT/0",
}


#: Prompts about a part, parsed by hand: {a} and {n} are the words of its name.
#: One line for each remainder of the part's key.
PART_PARSES = (
    "A/a/DET/det/1 photo/photo/NOUN/ROOT/1 of/of/ADP/prep/1 a/a/DET/det/7 {a}_/{a}/ADJ/amod/7 ,/,/PUNCT/punct/7 worn/worn/ADJ/amod/7 {n}/{n}/NOUN/pobj/2 blocking/block/VERB/acl/7 a/a/DET/det/10 doorway_/doorway/NOUN/dobj/8|{n}/{n}/NOUN/ROOT/0",
    "The/the/DET/det/1 {n}_/{n}/NOUN/poss/4 's/'s/PART/case/1 {a}/{a}/ADJ/amod/4 shadow/shadow/NOUN/nsubj/5 falls/fall/VERB/ROOT/5 under/under/ADP/prep/5 an/an/DET/det/8 oak_/oak/NOUN/pobj/6|{n}/{n}/NOUN/ROOT/0",
    "a/a/DET/det/4 very/very/ADV/advmod/2 {a}/{a}/ADJ/amod/4 {n}/{n}/NOUN/compound/4 spinning/spinning/NOUN/ROOT/4 in/in/ADP/prep/4 the/the/DET/det/7 dust_/dust/NOUN/pobj/5|{n}/{n}/NOUN/ROOT/0",
    "Two/two/NUM/nummod/2 {a}/{a}/ADJ/amod/2 {n}s/{n}/NOUN/nsubj/3 rest/rest/VERB/ROOT/3 beside/beside/ADP/prep/3 the/the/DET/det/7 {a}/{a}/ADJ/amod/7 {n}_/{n}/NOUN/pobj/4|{a}/{a}/ADJ/amod/1 {n}/{n}/NOUN/ROOT/1",
    "A/a/DET/det/1 painting/painting/NOUN/ROOT/1 of/of/ADP/prep/1 one/one/NUM/nummod/5 garden/garden/NOUN/compound/5 {n}/{n}/NOUN/pobj/2 by/by/ADP/prep/1 a/a/DET/det/8 fence_/fence/NOUN/pobj/6|{a}/{a}/ADJ/amod/1 {n}/{n}/NOUN/ROOT/1",
    "a/a/DET/det/2 {n}/{n}/NOUN/compound/2 rider/rider/NOUN/nsubj/3 waits/wait/VERB/ROOT/3 with/with/ADP/prep/3 a/a/DET/det/7 {a}/{a}/ADJ/amod/7 dog_/dog/NOUN/pobj/4|{n}/{n}/NOUN/ROOT/0",
    "A/a/DET/det/2 {a}/{a}/ADJ/amod/2 door/door/NOUN/ROOT/2 with/with/ADP/prep/2 ivy/ivy/NOUN/pobj/3 growing/grow/VERB/acl/4|{n}/{n}/NOUN/ROOT/0",
    "so/so/ADV/nmod/1 so/so/ADV/nmod/2 so/so/ADV/nmod/3 so/so/ADV/nmod/4 so/so/ADV/nmod/5 so/so/ADV/nmod/6 so/so/ADV/nmod/7 so/so/ADV/nmod/8 so/so/ADV/nmod/9 so/so/ADV/nmod/10 so/so/ADV/nmod/11 so/so/ADV/nmod/12 so/so/ADV/nmod/13 so/so/ADV/nmod/14 so/so/ADV/nmod/15 {a}/{a}/ADJ/amod/16 {n}/{n}/NOUN/ROOT/16 with/with/ADP/prep/16 handles_/handle/NOUN/pobj/17|{n}/{n}/NOUN/ROOT/0",
)


def _parsed(line: str) -> list[tuple]:
    rows = []
    for i, item in enumerate(line.split()):
        text, lemma, pos, dep, head = item.split("/")
        glued = text.endswith("_")
        text = text.rstrip("_")
        rows.append((i, text, not glued, text.lower(), lemma, pos, dep, int(head)))
    return rows


def fixture(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(tokens of the prompts, tokens of the subjects' names)."""
    both = []
    for side in (0, 1):
        rows = [(d, *r) for d, line in PARSES.items() for r in _parsed(line.split("|")[side])]
        both.append(spark.createDataFrame(rows, struct(TOKEN)))
    return both[0], both[1]


def part_tokens(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tokens of a prompt about each part, tokens of its subject's name), for a
    table of p_partkey and p_name."""
    adjective, noun = F.get(F.split("p_name", " "), F.lit(0)), F.get(F.split("p_name", " "), F.lit(1))
    fill = lambda x: F.replace(F.replace(x, F.lit("{a}"), F.coalesce(adjective, F.lit(""))), F.lit("{n}"), F.coalesce(noun, F.lit("")))
    fields = [f.name for f in struct(TOKEN).fields[1:]]
    out = []
    for side in (0, 1):
        lines = F.array(*[F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(fields, row, strict=True)]) for row in _parsed(line.split("|")[side])]) for line in PART_PARSES])
        rows = parts.select(F.col("p_partkey").cast("string").alias("doc_id"), "p_name", F.inline(F.get(lines, (F.col("p_partkey") % len(PART_PARSES)).cast("int"))))
        out.append(rows.select("doc_id", *[fill(F.col(k)).alias(k) if k in ("text", "lower", "lemma") else F.col(k) for k in fields]))
    return out[0], out[1]


def part_tokens_sql(side: int) -> str:
    """One side of ``part_tokens`` in SQL."""
    plain = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).lower()
    values = ", ".join(f"({k}, {', '.join(plain(v) for v in row)})" for k, line in enumerate(PART_PARSES) for row in _parsed(line.split("|")[side]))
    fill = lambda x: f"replace(replace({x}, '{{a}}', split_part(p_name, ' ', 1)), '{{n}}', split_part(p_name, ' ', 2))"
    return f"SELECT CAST(p_partkey AS VARCHAR) AS doc_id, i, {fill('text')} AS text, ws, {fill('lower')} AS lower, {fill('lemma')} AS lemma, pos, dep, head FROM part JOIN (VALUES {values}) AS t(k, i, text, ws, lower, lemma, pos, dep, head) ON p_partkey % {len(PART_PARSES)} = k"
