"""Chat formatting by schema fingerprints, in DataFrame functions only.

Heterogeneous records (as a reader merges them: one column a layout's field,
null where a record lacks it) are recognised by a hash of the nested field paths
that they fill. The hash selects a declarative mapping, and the mapping's
expression builds the canonical turns. A template then marks the turns, with
the control characters inside roles and texts escaped reversibly, and lists the
spans of the formatted text that a loss covers (assistant texts).

Edge cases: paths that no mapping names are ignored, so extra columns never
matter. A record that fits no mapping has layout ``unknown`` and no turns. Null
texts and roles are empty. Turns of equal number are ordered by role and text;
repeated rows are repeated turns. Texts of any length are read whole, and n turns
take n root n steps. An empty table gives an empty result. A
conversation is one value and so must fit a task; nothing else is gathered.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agreemill.llm.common import col, free_name

#: The template and its escapes, in the order they are applied.
BEGIN, STOP, BREAK = "<s>", "</s>", "\n"
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;"))
ROLE_ESCAPES = (*ESCAPES, ("\n", "&nl;"))
#: Code points of a text that are counted through at a time.
CHUNK = 2048
TURN = "struct<role: string, text: string>"


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns.

    Either ``fields``, (role, path) in order, or ``turns``, an array path whose
    elements hold ``role`` and ``text``. ``optional`` paths may be missing.
    ``join`` appends the text of a second field to that of a first.
    """

    name: str
    fields: tuple[tuple[str, str], ...] = ()
    turns: str = ""
    role: str = ""
    text: str = ""
    aliases: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()
    join: tuple[tuple[str, str], ...] = ()

    def paths(self) -> list[str]:
        if self.turns:
            return [f"{self.turns}[]", f"{self.turns}[].{self.role}", f"{self.turns}[].{self.text}"]
        return [p for _, p in self.fields] + [p for _, p in self.join]

    def path_sets(self) -> list[tuple[str, ...]]:
        """Every set of paths that this mapping takes."""
        fixed = [p for p in self.paths() if p not in self.optional]
        free = [p for p in self.paths() if p in self.optional]
        return [tuple(sorted([*fixed, *some])) for n in range(len(free) + 1) for some in combinations(free, n) if fixed or some]


MAPPINGS = (
    Mapping("prompt_response", fields=(("system", "system"), ("user", "prompt"), ("assistant", "response")), optional=("system",)),
    Mapping("prompt_completion", fields=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("instruction", fields=(("system", "system"), ("user", "instruction"), ("assistant", "output")), join=(("instruction", "input"),), optional=("system", "input")),
    Mapping("messages", turns="messages", role="role", text="content", optional=("messages[].role", "messages[].content")),
    Mapping("conversations", turns="conversations", role="from", text="value", aliases=(("human", "user"), ("gpt", "assistant")), optional=("conversations[].from", "conversations[].value")),
)


def _filled(schema: T.StructType, path: str) -> Column | None:
    """Whether a record fills ``path``; None where the schema has no such path."""
    head, _, leaf = path.partition("[]")
    field = next((f for f in schema.fields if f.name == head), None)
    if field is None:
        return None
    if not _ and not leaf:
        return col(head).isNotNull() if isinstance(field.dataType, T.StringType) else None
    if not isinstance(field.dataType, T.ArrayType) or not isinstance(field.dataType.elementType, T.StructType):
        return None
    if not leaf:
        return col(head).isNotNull()
    if leaf[1:] not in field.dataType.elementType.names:
        return None
    return F.coalesce(F.exists(col(head), lambda x: x[leaf[1:]].isNotNull()), F.lit(False))


def fingerprint(df: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> Column:
    """The hash of the sorted paths, of those any mapping names, that a record fills."""
    known = sorted({p for m in mappings for p in m.paths()})
    tests = [(p, t) for p in known if (t := _filled(df.schema, p)) is not None]
    return F.xxhash64(F.concat_ws("|", *[F.when(t, F.lit(p)) for p, t in tests]))


def _path_hash(paths: tuple[str, ...]) -> Column:
    return F.xxhash64(F.lit("|".join(paths)))


def _turns(df: DataFrame, m: Mapping) -> Column | None:
    """The canonical turns of a record of this layout, where the columns exist."""
    if m.turns:
        field = next((f for f in df.schema.fields if f.name == m.turns), None)
        if field is None or _filled(df.schema, f"{m.turns}[]") is None:
            return None
        names = field.dataType.elementType.names

        def turn(x: Column) -> Column:
            role = F.coalesce(x[m.role], F.lit("")) if m.role in names else F.lit("")
            for other, name in m.aliases:
                role = F.when(role == other, F.lit(name)).otherwise(role)
            return F.struct(role.alias("role"), (F.coalesce(x[m.text], F.lit("")) if m.text in names else F.lit("")).alias("text"))

        return F.transform(col(m.turns), turn)
    has = {p for p in m.paths() if _filled(df.schema, p) is not None}
    if any(p not in has and p not in m.optional for p in m.paths()):
        return None
    parts = []
    for role, path in m.fields:
        if path in has:
            text = col(path)
            for first, second in m.join:
                if first == path and second in has:
                    text = F.when(F.length(col(second)) > 0, F.concat(text, F.lit("\n\n"), col(second))).otherwise(text)
            parts.append(F.when(col(path).isNotNull(), F.struct(F.lit(role).alias("role"), text.alias("text"))))
    return F.array_compact(F.array(*parts))


def canonical_turns(df: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Add ``fingerprint``, ``layout`` and ``turns``, which replace columns of these names."""
    mark = free_name(df, "fingerprint_")
    layout, turns = F.lit("unknown"), F.array().cast(f"array<{TURN}>")
    for m in reversed(mappings):
        built = _turns(df, m)
        if built is not None:
            fits = None
            for paths in m.path_sets():
                one = col(mark) == _path_hash(paths)
                fits = one if fits is None else fits | one
            layout = F.when(fits, F.lit(m.name)).otherwise(layout)
            turns = F.when(fits, built.cast(f"array<{TURN}>")).otherwise(turns)
    kept = [col(c) for c in df.columns if c.lower() not in ("fingerprint", "layout", "turns")]
    return df.withColumn(mark, fingerprint(df, mappings)).select(*kept, col(mark).alias("fingerprint"), layout.alias("layout"), turns.alias("turns"))


def escape(text: Column, escapes: tuple[tuple[str, str], ...] = ESCAPES) -> Column:
    for plain, safe in escapes:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column, escapes: tuple[tuple[str, str], ...] = ESCAPES) -> Column:
    for plain, safe in reversed(escapes):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def _running(df: DataFrame, lengths: str, name: str) -> DataFrame:
    """Add the sum of the lengths before each place of an array column, from 0.

    Blocks of about the root of the array's length are added up first, then each
    place adds the blocks before its own and the rest, so that n places take
    n root n steps. What a lambda reads is a column of its own, read twice.
    """
    size, blocks, bases = (free_name(df, f"{name}_{x}") for x in ("size", "blocks", "bases"))
    x, k, own, base = (F.col(c) for c in (lengths, size, blocks, bases))
    upto = lambda n: F.slice(F.sequence(F.lit(0), n), F.lit(1), n)
    # places are looked up one by one: a slice would copy the whole array
    add = lambda array, start, end: F.when(end > start, F.aggregate(F.sequence(start, end - 1), F.lit(0).cast("long"), lambda s, j: s + F.get(array, j))).otherwise(F.lit(0).cast("long"))
    df = df.withColumn(size, F.greatest(F.lit(1), F.floor(F.sqrt(F.size(lengths))).cast("int")))
    count = F.ceil(F.size(lengths) / k).cast("int")
    df = df.withColumn(blocks, F.when(F.size(x) >= 0, F.transform(upto(count), lambda i: add(x, i * k, F.least((i + 1) * k, F.size(x))))))
    df = df.withColumn(bases, F.when(F.size(own) >= 0, F.transform(upto(F.size(own)), lambda i: add(own, F.lit(0), i))))
    at = lambda i: F.floor(i / k).cast("int")
    sums = F.transform(upto(F.size(x)), lambda i: F.get(base, at(i)) + add(x, at(i) * k, i))
    return df.withColumn(name, F.when((F.size(x) >= 0) & (F.size(base) >= 0), sums)).drop(size, blocks, bases)


def format_turns(df: DataFrame, turns: str = "turns", loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Add ``formatted`` and ``loss_spans``, which replace columns of these names:
    (start, length) in code points from 0."""
    parts = F.transform(
        col(turns),
        lambda t: F.struct(
            F.concat(F.lit(BEGIN), escape(t["role"], ROLE_ESCAPES), F.lit(BREAK)).alias("head"),
            escape(t["text"]).alias("body"),
            t["role"].isin(*loss_roles).alias("loss"),
        ),
    )
    names = [free_name(df, x) for x in ("parts", "lengths", "starts")]
    part, length, start = (col(n) for n in names)
    kept = [col(c) for c in df.columns if c.lower() not in ("formatted", "loss_spans")]
    out = df.withColumn(names[0], parts)
    out = out.withColumn(names[1], F.transform(part, lambda p: (F.char_length(p["head"]) + F.char_length(p["body"]) + F.lit(len(STOP))).cast("long")))
    out = _running(out, names[1], names[2])
    formatted = F.array_join(F.transform(part, lambda p: F.concat(p["head"], p["body"], F.lit(STOP))), "")
    spans = F.transform(F.arrays_zip(part.alias("p"), start.alias("s")), lambda x: F.when(x["p"]["loss"], F.struct((x["s"] + F.char_length(x["p"]["head"])).alias("start"), F.char_length(x["p"]["body"]).cast("long").alias("length"))))
    return out.select(*kept, formatted.alias("formatted"), F.array_compact(spans).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns, parsed back from the formatted text."""
    pieces = F.split(formatted, STOP, -1)
    pieces = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, BREAK, 1)
        body = F.substring(piece, F.char_length(role) + 1 + len(BREAK), F.char_length(piece))
        return F.struct(unescape(F.substring(role, F.lit(1 + len(BEGIN)), F.char_length(role)), ROLE_ESCAPES).alias("role"), unescape(body).alias("text"))

    return F.transform(pieces, turn)


def with_loss(df: DataFrame, name: str = "loss") -> DataFrame:
    """Add the text under the loss mask, unescaped, nothing between the spans.

    A place in a string is counted from its start, so the text is cut once into
    chunks of ``CHUNK`` code points, and a span reads the chunks that it lies in.
    """
    chunks = free_name(df, "chunks")
    out = df.withColumn(chunks, F.regexp_extract_all("formatted", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)))

    def read(start: Column, end: Column) -> Column:
        place = lambda at, i: F.least(F.greatest(at - i * CHUNK, F.lit(0)), F.lit(CHUNK)).cast("int")
        part = lambda i: F.substring(F.get(col(chunks), i), place(start, i) + 1, place(end, i) - place(start, i))
        return F.array_join(F.transform(F.sequence(F.floor(start / CHUNK).cast("int"), F.floor(F.greatest(end - 1, start) / CHUNK).cast("int")), part), "")

    cut = F.transform("loss_spans", lambda s: F.when(s["length"] > 0, unescape(read(s["start"], s["start"] + s["length"]))).otherwise(""))
    return out.withColumn(name, F.when(F.size(chunks) >= 0, F.array_join(cut, ""))).drop(chunks)


def records(rows: DataFrame) -> DataFrame:
    """Conversation rows as records in the layouts that such data comes in.

    A prompt with an answer is a prompt/response record; with a system line in
    front, an instruction record; any other conversation is a list of messages.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    roles = F.array_join(F.transform("t", lambda x: escape(x["role"], ROLE_ESCAPES)), "<")
    pair, triple = roles == "user<assistant", roles == "system<user<assistant"

    def text(shape: Column, at: int) -> Column:
        return F.when(shape, F.get(F.col("t"), F.lit(at))["text"])

    return grouped.select(
        "conv_id",
        text(pair, 0).alias("prompt"),
        text(pair, 1).alias("response"),
        text(triple, 0).alias("system"),
        text(triple, 1).alias("instruction"),
        text(triple, 2).alias("output"),
        F.when(~(pair | triple), F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))).alias("messages"),
    )


def formatted_conversations(conversations: DataFrame) -> DataFrame:
    """The op7 query."""
    spark = conversations.sparkSession
    extra = spark.sql("SELECT -1L AS conv_id, t AS turn, r AS role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(t, r)")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").union(extra)
    done = format_turns(canonical_turns(records(rows)))
    back = with_loss(done).select("conv_id", "layout", "formatted", read_turns(F.col("formatted")).alias("turns"), "loss")
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE_SQL = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;'))
    + length(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;'), chr(10), '&nl;')) AS n FROM r
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n + 8) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
