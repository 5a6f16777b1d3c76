"""Queries over stored conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from daygrid.operators import dialogue as D
from daygrid.plans.registry import query
from daygrid.session import durable

ROUNDS = """
prev AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
flags AS (SELECT *, role = 'assistant' AND coalesce(before <> 'user', true) AS lone FROM prev),
rounds AS (SELECT *, CAST(sum(CASE WHEN role = 'user' OR lone THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS r FROM flags)"""


def export_text(role, text):
    """One turn in the shape of an exported source file."""
    return F.concat(
        F.lit('client = Client(api_key=os.environ.get("SOME_KEY"))\nmodel = "some-model"\ncontents = [\n  types.Content(\n    role="'),
        role, F.lit('", parts=[types.Part.from_text(text="""'), text, F.lit('"""),],\n  ),\n]\n'),
    )


def exported(t):
    return t.conversations.select(
        F.concat_ws("-", "conv_id", "turn").alias("file"), export_text(F.col("role"), F.col("text")).alias("value")
    )


HEAD = 'client = Client(api_key=os.environ.get("SOME_KEY"))\nmodel = "some-model"\ncontents = [\n'


def exported_conversations(t):
    """A file per conversation, all its turns in order."""
    part = lambda x: F.concat(F.lit('  types.Content(\n    role="'), x["role"], F.lit('", parts=[types.Part.from_text(text="""'), x["text"], F.lit('"""),],\n  ),\n'))
    turns = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return turns.select(F.col("conv_id").cast("string").alias("file"), F.concat(F.lit(HEAD), F.array_join(F.transform("turns", part), ""), F.lit("]\n")).alias("value"))


@query("extracted_conversations", "C1", """
SELECT CAST(conv_id AS VARCHAR) AS file, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS turn, role,
       regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') AS text FROM conversations""")
def extracted_conversations(t):
    """Files with several turns: numbered in their order."""
    return D.extract_turns(exported_conversations(t))


@query("rounds_of_exports", "C1 C3", """
, place AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM rounds)
SELECT CAST(conv_id AS VARCHAR) AS file, CAST(n AS INTEGER) AS turn, role, CASE WHEN role IN ('user', 'assistant') THEN r END AS round, lone AS is_lone_reply FROM place""", ROUNDS)
def rounds_of_exports(t):
    """Extraction and pairing one after the other, by way of stored turns."""
    turns = durable(D.extract_turns(exported_conversations(t)).select(F.col("file").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role"), "turns")
    out = D.with_rounds(turns, reply="assistant")
    return out.select(F.col("conv_id").alias("file"), F.col("turn").cast("int").alias("turn"), "role", "round", "is_lone_reply")


@query("extracted_turns", "C1", """
SELECT concat(conv_id, '-', turn) AS file, CAST(1 AS INTEGER) AS turn, role,
       regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') AS text FROM conversations""")
def extracted_turns(t):
    return D.extract_turns(exported(t))


@query("export_metadata", "C2", """
, e AS (SELECT concat(conv_id, '-', turn) AS file, concat('client = Client(api_key=os.environ.get("SOME_KEY"))\n', 'model = "some-model"\n', 'contents = [\n  types.Content(\n    role="',
          role, '", parts=[types.Part.from_text(text="\""', text, '"\""),],\n  ),\n]\n') AS v FROM conversations)
SELECT file, 'some-model' AS model, 'SOME_KEY' AS key_name, CAST(length(v) AS INTEGER) AS n_chars,
       CAST(length(v) - length(replace(v, chr(10), '')) + 1 AS INTEGER) AS n_lines FROM e""".replace('"\\""', '"""').replace("\\n", "'||chr(10)||'"), "none AS (SELECT 1)")
def export_metadata(t):
    return D.file_metadata(exported(t))


@query("conversation_rounds", "C3", """
SELECT conv_id, turn, role, CASE WHEN role IN ('user', 'assistant') THEN r END AS round, lone AS is_lone_reply FROM rounds""", ROUNDS)
def conversation_rounds(t):
    out = D.with_rounds(t.conversations.select("conv_id", "turn", "role"), reply="assistant")
    return out.select("conv_id", "turn", "role", "round", "is_lone_reply")


MARKERS = " + ".join(f"CAST(contains(text, '{m}') AS INTEGER)" for m in D.CODE_MARKERS)


@query("code_like_turns", "C4", f"""
SELECT conv_id, turn, NOT contains(text, '```') AND (({MARKERS}) >= 3 OR length(text) - length(replace(text, chr(10), '')) > 10) AS code
FROM conversations""")
def code_like_turns(t):
    return t.conversations.select("conv_id", "turn", D.is_code_like(F.col("text")).alias("code"))


@query("code_like_documents", "C4", f"""
SELECT doc_id, NOT contains(text, '```') AND (({MARKERS}) >= 3 OR length(text) - length(replace(text, chr(10), '')) > 10) AS code
FROM documents""")
def code_like_documents(t):
    return t.documents.select("doc_id", D.is_code_like(F.col("text")).alias("code"))


TOC = """
users AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS entry, count(*) OVER (PARTITION BY conv_id) AS n
          FROM conversations WHERE role = 'user'),
toc AS (SELECT conv_id, entry, trim(replace(substr(text, 1, 50), chr(10), ' ')) || CASE WHEN length(text) > 50 THEN '...' ELSE '' END AS title
        FROM users WHERE n > 3)"""


@query("contents_tables", "C5", "SELECT conv_id, entry, title FROM toc", TOC)
def contents_tables(t):
    return D.contents_table(t.conversations)


@query("conversation_documents", "C6", f"""
, blocks AS (
  SELECT conv_id, 0 AS section, CAST(0 AS BIGINT) AS place, '# Conversation ' || conv_id || chr(10) || chr(10) || 'Turns: ' || count(*) || chr(10) AS block
  FROM conversations GROUP BY 1
  UNION ALL SELECT conv_id, 1, entry, entry || '. [Round ' || entry || ': ' || title || '](#round-' || entry || ')' FROM toc
  UNION ALL SELECT conv_id, 2, turn,
    CASE WHEN role = 'user' THEN '### Round ' || r || chr(10) || chr(10) || '#### User' || chr(10)
         WHEN lone THEN '### Message ' || r || chr(10) || chr(10) || '#### Assistant' || chr(10) ELSE '#### Assistant' || chr(10) END
    || chr(10) || CASE WHEN NOT contains(text, '```') AND (({MARKERS}) >= 3 OR length(text) - length(replace(text, chr(10), '')) > 10)
                       THEN '```python' || chr(10) || text || chr(10) || '```' ELSE text END || chr(10)
  FROM rounds WHERE role IN ('user', 'assistant'))
SELECT * FROM blocks""",
       ROUNDS + "," + TOC)
def conversation_documents(t):
    return D.document_blocks(t.conversations, reply="assistant")
