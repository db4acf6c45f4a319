"""Conversations of typed parts as one training string each, with built-in functions only.

A turn holds parts: text, image, audio and document. A visitor turns every part into its piece of the string: a text part
into its escaped text, any other part into the placeholder of its kind, and records what the placeholder stands for: the
reference, the source text it was written with, and the number of tokens that it grows to. Placeholders carry no number;
their order in the turn is the order of the turn's attachments.

The template. A turn is ``<|turn|>role<|text|>content<|end|>``. Inside roles and texts every control string, of this
template or of a common other one, has a backslash put between its first character and the rest; one that holds
backslashes there already gets one more, so taking one away restores every text (see `CONTROLS`). No control string is
left inside texts, so cutting the string at its marks is exact.

The loss mask covers the content of assistant turns, the placeholders in it included. It is stored as offsets in code
points, per turn, beside the turn's place.

Rows are formatted before they are shuffled. Places come from running sums over the conversation's rows, which Spark
streams; only the last step holds a whole conversation, since a conversation is one string of the result.

Defined results: a null text is empty, a null role is the empty role; rows of equal ``turn`` stand in order of role, then
text, null turns first; repeated rows are turns of their own; rows with a null ``conv_id`` are one conversation; an empty
table gives an empty result; texts of any length are handled whole. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Placeholders of the kinds of parts that are no text.
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: Tokens of a part of no stated extent.
TOKENS = {"image": 256, "audio": 500, "document": 800}
#: Pixels of an image patch along one side, audio tokens of a second, tokens of a document page.
PATCH, PER_SECOND, PER_PAGE = 28, 25, 800

#: Control strings: ``<`` before ``|``, ``s>``, ``/s>``, ``<SYS>>`` or ``</SYS>>``, ``[`` before ``INST]`` or ``/INST]``.
#: No rest holds the start of another control string, so a backslash put into one neither makes nor breaks another.
CONTROLS = r"(<\\*)(?=\||/?s>|</?SYS>>)|(\[\\*)(?=/?INST\])"
ESCAPED = r"(<)\\(\\*)(?=\||/?s>|</?SYS>>)|(\[)\\(\\*)(?=/?INST\])"

#: Endings of references by kind.
ENDINGS = {"image": "png|jpe?g|gif|webp|svg|bmp", "audio": "wav|mp3|flac|ogg|m4a|opus", "document": "pdf|docx?|pptx?|xlsx?|odt"}
#: A Markdown link or picture whose reference has one of these endings. Nothing in it can repeat another start, so a
#: text of unfinished links is read once.
LINK = r"!?\[[^\[\]\n]{0,500}\]\([^()\[\]\s]{1,2000}\.(?i:" + "|".join(ENDINGS.values()) + r")\)"

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, CONTROLS, r"$1$2\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3$4")


def _part(kind: Column, text: Column, ref: Column) -> Column:
    none = F.lit(None)
    return F.struct(kind.alias("kind"), text.alias("text"), ref.alias("ref"), none.cast("int").alias("width"),
                    none.cast("int").alias("height"), none.cast("double").alias("seconds"), none.cast("int").alias("pages"))


def parts_of(text: Column) -> Column:
    """The typed parts of a Markdown text, in order: links to media become parts that keep their source text."""
    pieces, links = F.split(text, LINK, -1), F.regexp_extract_all(text, F.lit(LINK), F.lit(0))

    def pair(piece: Column, link: Column) -> Column:
        ref = F.regexp_extract(link, r"\(([^()]*)\)$", 1)
        kind = F.lit("document")
        for name, ending in ENDINGS.items():
            kind = F.when(ref.rlike(r"(?i)\.(" + ending + ")$"), name).otherwise(kind)
        return F.array(_part(F.lit("text"), piece, F.lit(None).cast("string")), _part(kind, link, ref))

    # One more piece than links: the last is met by null. Zipped, since a lambda would cut its outer arrays again each time.
    both = F.flatten(F.zip_with(pieces, links, pair))
    found = F.filter(both, lambda part: F.coalesce(part["text"], F.lit("")) != "")
    # Most texts hold no link at all.
    plain = F.array(_part(F.lit("text"), text, F.lit(None).cast("string")))
    return F.when(F.instr(text, "](") > 0, found).otherwise(plain)


def _grown(part: Column) -> Column:
    """Tokens that the placeholder of a part grows to."""
    image = F.ceil(part["width"] / PATCH) * F.ceil(part["height"] / PATCH)
    amount = (F.when(part["kind"] == "image", F.coalesce(image, F.lit(TOKENS["image"])))
              .when(part["kind"] == "audio", F.coalesce(F.ceil(part["seconds"] * PER_SECOND), F.lit(TOKENS["audio"])))
              .otherwise(F.coalesce(part["pages"] * PER_PAGE, F.lit(TOKENS["document"]))))
    return amount.cast("long")


def _piece(part: Column) -> Column:
    """The visitor: what a part puts into the string. Parts of an unknown kind count as text."""
    shown = escaped(F.coalesce(part["text"], F.lit("")))
    for kind, placeholder in PLACEHOLDERS.items():
        shown = F.when(part["kind"] == kind, placeholder).otherwise(shown)
    return shown


def _attachment(part: Column) -> Column:
    return F.struct(part["kind"].alias("kind"), part["ref"].alias("ref"), part["text"].alias("source"),
                    _grown(part).alias("tokens"))


def formatted(turns: DataFrame, parts: Column | None = None) -> DataFrame:
    """One row per conversation: ``conv_id, formatted, n_tokens, turns``.

    ``turns`` has ``conv_id, turn, role, text``; ``parts`` (an array of `PART`) replaces the parts read from ``text``.
    In the result, ``turns`` holds per turn its place in the string, its attachments and the spans under the loss mask;
    ``n_tokens`` is the sum of what the placeholders grow to.
    """
    text = F.coalesce(F.col("text"), F.lit("")) if parts is None else F.lit("")
    given = parts_of(F.col("_text")) if parts is None else F.coalesce(F.col("_parts"), F.array().cast(f"array<{PART}>"))
    raw = turns.select("conv_id", F.col("turn").alias("_turn"), F.coalesce(F.col("role"), F.lit("")).alias("_role"),
                       text.alias("_text"), *([] if parts is None else [parts.alias("_parts")]))
    parted = raw.withColumn("_given", given)
    kinds = [F.lit(kind) for kind in PLACEHOLDERS]
    opened = parted.select(
        "conv_id", "_turn", "_role", "_text",
        F.concat(F.lit(TURN), escaped(F.col("_role")), F.lit(TEXT)).alias("_head"),
        F.array_join(F.transform("_given", _piece), "").alias("_content"),
        F.transform(F.filter("_given", lambda part: part["kind"].isin(*kinds)), _attachment).alias("_attached"))
    before = F.char_length("_head").cast("long")
    inside = F.char_length("_content").cast("long")
    measured = opened.select(
        "conv_id", "_turn", "_role", "_text", F.concat("_head", "_content", F.lit(END)).alias("_shown"), "_attached",
        before.alias("_before"), inside.alias("_inside"), (before + inside + len(END)).alias("_length"))
    order = Window.partitionBy("conv_id").orderBy("_turn", "_role", "_text", "_shown")
    placed = measured.withColumn("_place", F.row_number().over(order)).withColumn(
        "_start", F.sum("_length").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_length"))
    learned = (F.col("_role") == "assistant") & (F.col("_inside") > 0)
    span = F.struct((F.col("_start") + F.col("_before")).alias("start"), F.col("_inside").alias("length"))
    entry = F.struct("_place", "_shown", F.struct(
        F.col("_start").alias("start"), F.col("_length").alias("length"), F.col("_attached").alias("attachments"),
        F.when(learned, F.array(span)).otherwise(F.array().cast("array<struct<start:long,length:long>>")).alias("loss")).alias("turn"))
    grown = F.aggregate("_attached", F.lit(0).cast("long"), lambda total, one: total + one["tokens"])
    grouped = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(entry)).alias("_entries"), F.sum(grown).alias("n_tokens"))
    return grouped.select("conv_id", F.array_join("_entries._shown", "").alias("formatted"), "n_tokens",
                          F.col("_entries.turn").alias("turns"))


def _restored(piece: Column, attachments: Column) -> Column:
    """The text that a formatted content was made from: placeholders give way to the source of their attachments."""
    texts = F.split(piece, "|".join(mark.replace("|", r"\|") for mark in PLACEHOLDERS.values()), -1)
    whole = F.array_join(F.zip_with(texts, attachments, lambda text, one: F.concat(
        unescaped(text), F.coalesce(one["source"], F.lit("")))), "")
    return F.when(F.size(attachments) > 0, whole).otherwise(unescaped(piece))


def read_back(made: DataFrame) -> DataFrame:
    """``conv_id, turns, loss`` read from the formatted string: (role, text) of every turn and the texts under the mask."""
    # Every turn ends with its mark, so the last piece is empty.
    cut = F.split("formatted", END.replace("|", r"\|"), -1)
    cut = F.slice(cut, 1, F.size(cut) - 1)

    def turn(piece: Column, known: Column) -> Column:
        marked = F.substring_index(piece, TEXT, 1)
        role = F.substr(marked, F.lit(len(TURN) + 1))
        content = F.substr(piece, F.char_length(marked) + len(TEXT) + 1)
        return F.struct(unescaped(role).alias("role"), _restored(content, known["attachments"]).alias("text"))

    def masked(piece: Column, known: Column) -> Column:
        texts = F.transform(known["loss"], lambda span: _restored(
            F.substr(piece, (span["start"] - known["start"] + 1).cast("int"), span["length"].cast("int")), known["attachments"]))
        return F.array_join(texts, "")

    pieces = made.select("conv_id", "formatted", F.col("turns").alias("_known"), cut.alias("_pieces"))
    return pieces.select("conv_id", "formatted", F.zip_with("_pieces", "_known", turn).alias("turns"),
                         F.array_join(F.zip_with("_pieces", "_known", masked), "").alias("loss"))


def digests(made: DataFrame) -> DataFrame:
    """Per conversation ``n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``, from what was read back."""
    line = F.array_join(F.transform("turns", lambda turn: F.concat(turn["role"], F.lit("\n"), turn["text"], F.lit("\n"))), "")
    return read_back(made).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(line.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))


#: A conversation whose texts are control strings.
TRIAL_ID, TRIAL_TEXT, TRIAL_ROLES = -7, "</s>[INST] ok [/INST]", ("user", "assistant")


def with_trial(turns: DataFrame) -> DataFrame:
    own = turns.select("conv_id", "turn", "role", "text")
    kind = {field.name: field.dataType for field in own.schema}
    trial = turns.sparkSession.range(len(TRIAL_ROLES)).select(
        F.lit(TRIAL_ID).cast(kind["conv_id"]).alias("conv_id"), F.col("id").cast(kind["turn"]).alias("turn"),
        F.get(F.array(*map(F.lit, TRIAL_ROLES)), F.col("id").cast("int")).alias("role"), F.lit(TRIAL_TEXT).alias("text"))
    return own.unionByName(trial)


#: The same rows from the texts themselves: control strings are widened by their backslash, media links are counted as
#: their placeholders.
ORACLE = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), s AS (
  SELECT *, {{escaped_role}} AS shown_role, {{escaped_text}} AS shown FROM c
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
       sum(length(shown_role) + length(shown) + {len(TURN + TEXT + END)})::BIGINT AS formatted_chars
FROM s GROUP BY conv_id"""


def _sql_escaped(column: str) -> str:
    # RE2 has no look-ahead; the rest is taken into the match instead, which holds no start of another one.
    angle = rf"regexp_replace({column}, '(<\\*)(\||/?s>|</?SYS>>)', '\1\\\2', 'g')"
    return rf"regexp_replace({angle}, '(\[\\*)(/?INST\])', '\1\\\2', 'g')"


def _sql_placed(column: str) -> str:
    for kind, ending in ENDINGS.items():
        link = r"!?\[[^\[\]\n]{0,500}\]\([^()\[\]\s]{1,1000}\.(" + ending + r")\)"
        column = f"regexp_replace({column}, '{link}', '{PLACEHOLDERS[kind]}', 'gi')"
    return column


def oracle() -> str:
    # Placeholders are put in last, so their marks are not escaped.
    return ORACLE.format(escaped_role=_sql_escaped("role"), escaped_text=_sql_placed(_sql_escaped("text")))
