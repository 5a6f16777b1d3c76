"""Stored conversations: turns, rounds, contents tables and Markdown documents.

A conversation may be arbitrarily long: rounds are numbered with bucketed running
sums, and documents are ordered blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daygrid.operators.running import BUCKET, running_row_sums, with_bucket, with_previous

# Text that hints at program code.
CODE_MARKERS = (
    "import ", "def ", "class ", "if __name__", "print(", "return ",
    "import pandas", "import numpy", "import matplotlib", "import seaborn",
    ".py", ".csv", "DataFrame", "plt.", "sns.", "def main", "# ",
    "for ", "while ", "try:", "except:", "with open",
)
# Patterns of an exported source file.
TURN_PATTERN = (
    r"(?s)types\.Content\s*\(\s*role\s*=\s*[\"'](\w+)[\"'].*?text\s*=\s*\"\"\"(.*?)\"\"\"\s*\)"
)
MODEL_PATTERN = r"model\s*=\s*[\"']([^\"']+)[\"']"
KEY_PATTERN = r"api_key\s*=\s*os\.environ\.get\([\"']([^\"']+)[\"']\)"


def strip(text: Column) -> Column:
    """Remove white space of any kind from both ends."""
    return F.regexp_replace(text, r"^[\s\x{1c}-\x{1f}\x{85}]+|[\s\x{1c}-\x{1f}\x{85}]+$", "")


def contents_section(text: Column) -> Column:
    """From "contents = [" to its matching bracket; empty when there is none."""
    spaced, tight = F.instr(text, "contents = ["), F.instr(text, "contents=[")
    start = F.when(spaced > 0, spaced).otherwise(tight)
    tail = F.when(start > 0, text.substr(start, F.length(text)))
    pieces = F.split(tail, r"(?<=[\[\]])")
    begin = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("size"), F.lit(False).alias("closed"))

    def step(acc, piece):
        depth = acc["depth"] + F.when(piece.endswith("["), 1).when(piece.endswith("]"), -1).otherwise(0)
        grown = F.struct(
            depth.alias("depth"), (acc["size"] + F.length(piece)).alias("size"),
            (piece.endswith("]") & (depth == 0)).alias("closed"),
        )
        return F.when(acc["closed"], acc).otherwise(grown)

    end = F.aggregate(pieces, begin, step)
    return F.coalesce(F.when(end["closed"], F.left(tail, end["size"])), F.lit(""))


def extract_turns(files: DataFrame, text: str = "value", file: str = "file") -> DataFrame:
    """(file, turn, role, text): the turns of each exported file, stripped, from 1."""
    section = files.select(file, contents_section(F.col(text)).alias("_s"))
    roles = F.regexp_extract_all("_s", F.lit(TURN_PATTERN), F.lit(1))
    texts = F.regexp_extract_all("_s", F.lit(TURN_PATTERN), F.lit(2))
    pairs = section.select(file, F.posexplode(F.arrays_zip(roles.alias("role"), texts.alias("text"))))
    return pairs.select(
        file, (F.col("pos") + 1).alias("turn"), F.col("col.role").alias("role"),
        strip(F.col("col.text")).alias("text"),
    )


def file_metadata(files: DataFrame, text: str = "value", file: str = "file") -> DataFrame:
    """(file, model, key_name, n_chars, n_lines); names are null when not found."""
    t = F.col(text)

    def found(pattern: str) -> Column:
        hit = F.regexp_extract(t, pattern, 1)
        return F.when(hit != "", hit)

    return files.select(
        file, found(MODEL_PATTERN).alias("model"), found(KEY_PATTERN).alias("key_name"),
        F.length(t).alias("n_chars"),
        (F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1).alias("n_lines"),
    )


def with_rounds(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", reply: str = "model"
) -> DataFrame:
    """Round number of each user turn and reply; other roles have none.

    A user turn opens a round and the reply directly after it shares it; any other
    reply opens a round of its own. (conv, turn) must be unique.
    """
    prev = with_previous(with_bucket(turns, turn), [conv], turn, {role: "_before"})
    user, answer = F.col(role) == "user", F.col(role) == reply
    paired = answer & F.coalesce(F.col("_before") == "user", F.lit(False))
    opens = (user | (answer & ~paired)).cast("int")
    flagged = prev.withColumns({"_opens": opens, "is_lone_reply": answer & ~paired})
    numbered = running_row_sums(flagged, [conv], turn, {"_opens": "_round"})
    placed = numbered.withColumn("round", F.when(user | answer, F.col("_round")))
    return placed.drop("_before", "_opens", "_round", BUCKET)


def is_code_like(text: Column) -> Column:
    """Not fenced already, and at least three markers or more than ten line breaks."""
    markers = sum((text.contains(m).cast("int") for m in CODE_MARKERS), F.lit(0))
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return ~text.contains("```") & ((markers >= 3) | (breaks > 10))


def formatted(text: Column) -> Column:
    return F.when(is_code_like(text), F.concat(F.lit("```python\n"), text, F.lit("\n```"))).otherwise(text)


def contents_table(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    more_than: int = 3,
) -> DataFrame:
    """(conv, entry, title) for conversations with more than three user turns.

    Entries count user turns only; titles are the first 50 characters on one line.
    """
    users = turns.where(F.col(role) == "user")
    many = users.groupBy(conv).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > more_than)
    numbered = running_row_sums(users.withColumn("_one", F.lit(1)), [conv], turn, {"_one": "entry"})
    head = F.trim(F.replace(F.left(F.col(text), F.lit(50)), F.lit("\n"), F.lit(" ")))
    title = F.when(F.length(text) > 50, F.concat(head, F.lit("..."))).otherwise(head)
    return numbered.join(many, conv, "left_semi").select(conv, "entry", title.alias("title"))


def document_blocks(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    reply: str = "model",
) -> DataFrame:
    """(conv, section, place, block): ordered Markdown blocks of every conversation.

    Sections: 0 heading with the number of turns, 1 contents, 2 messages.
    """
    counts = turns.groupBy(conv).agg(F.count(F.lit(1)).alias("_n"))
    heading = counts.select(
        conv, F.lit(0).alias("section"), F.lit(0).cast("long").alias("place"),
        F.format_string("# Conversation %s\n\nTurns: %d\n", F.col(conv).cast("string"), F.col("_n")).alias("block"),
    )
    toc = contents_table(turns, conv, turn, role, text).select(
        conv, F.lit(1).alias("section"), F.col("entry").cast("long").alias("place"),
        F.format_string("%d. [Round %d: %s](#round-%d)", "entry", "entry", "title", "entry").alias("block"),
    )
    rounds = with_rounds(turns, conv, turn, role, reply).where(F.col("round").isNotNull())
    head = (
        F.when(F.col(role) == "user", F.format_string("### Round %d\n\n#### User\n", "round"))
        .when(F.col("is_lone_reply"), F.format_string("### Message %d\n\n#### Assistant\n", "round"))
        .otherwise(F.lit("#### Assistant\n"))
    )
    body = rounds.select(
        conv, F.lit(2).alias("section"), F.col(turn).cast("long").alias("place"),
        F.concat(head, F.lit("\n"), formatted(F.col(text)), F.lit("\n")).alias("block"),
    )
    return heading.unionByName(toc).unionByName(body)


def write_documents(blocks: DataFrame, path: str, conv: str = "conv_id") -> None:
    """One Markdown text per conversation, under ``<conv>=…`` in ``path``.

    Blocks are sorted and streamed to their file; no conversation is held in memory.
    """
    ordered = blocks.repartition(conv).sortWithinPartitions(conv, "section", "place")
    ordered.select(conv, "block").write.partitionBy(conv).text(path)
