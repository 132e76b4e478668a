"""Chat formatting with typed content parts, in Column expressions only.

A turn's content is a list of parts: text, image, audio or document. The visitor walks the parts in order: text is escaped, any other part becomes a placeholder such as <image_3>, numbered through the conversation, and leaves an attachment record: placeholder, kind, reference and the tokens that it expands to (units times TOKENS of its kind; text has none). Turns are written [INST]role[/INST]content</s>; `&`, `<` and `[` in texts and roles are escaped, so no text can hold a control string or a placeholder, and unescaping gives it back exactly.

The loss mask is a list of spans over code points of the output, one for each assistant turn: turn, at (within the turn), start (within the output) and length.

Null texts, roles and parts are empty. Rows of a conversation are sorted by turn, role, text: equal turns keep a defined order and repeated rows stay. A null conv_id is a conversation. Other columns are ignored. An empty table gives no rows. A conversation is one string, so its turns meet in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, SAYS, CLOSE = "[INST]", "[/INST]", "</s>"
TOKENS = {"image": 256, "audio": 25, "document": 512}  #: for each tile, second, page
PARTS = "array<struct<type:string,text:string,ref:string,units:long>>"
PROBE = "</s>[INST] ok [/INST]"


def escape(x: Column) -> Column:
    return F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("["), F.lit("&lsqb;"))


def unescape(x: Column) -> Column:
    return F.replace(F.replace(F.replace(x, F.lit("&lsqb;"), F.lit("[")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def text_part(text: Column) -> Column:
    """A plain text as a list of parts."""
    none = F.lit(None).cast("string")
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), none.alias("ref"), F.lit(None).cast("long").alias("units")))


def _attached(part: Column) -> Column:
    return F.coalesce(part["type"] != "text", F.lit(False))


def _kind(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text"))


def flatten(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, parts -> conv_id, formatted, loss_spans, attachments, attachment_tokens, n_turns."""
    role = F.coalesce("role", F.lit(""))
    parts = F.coalesce("parts", F.array().cast(PARTS))
    t = turns.select("conv_id", "turn", role.alias("role"), parts.alias("parts"))
    t = t.withColumn("order", F.concat_ws("\x00", F.transform("parts", lambda p: F.coalesce(p["text"], p["ref"], F.lit("")))))
    line = Window.partitionBy("conv_id").orderBy("turn", "role", "order")
    earlier = line.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("seen", F.coalesce(F.sum(F.size(F.filter("parts", _attached))).over(earlier), F.lit(0)))
    name = lambda p, i: F.concat(F.lit("<"), escape(_kind(p)), F.lit("_"), (F.col("seen") + F.size(F.filter(F.slice("parts", F.lit(1), i), _attached)) + 1).cast("string"), F.lit(">"))
    content = F.array_join(F.transform("parts", lambda p, i: F.when(_attached(p), name(p, i)).otherwise(escape(F.coalesce(p["text"], F.lit(""))))), "")
    spent = F.create_map(*[x for k, v in TOKENS.items() for x in (F.lit(k), F.lit(v))])
    record = lambda p, i: F.when(_attached(p), F.struct(name(p, i).alias("placeholder"), _kind(p).alias("type"), p["ref"].alias("ref"), (F.coalesce(p["units"], F.lit(1)) * F.coalesce(F.try_element_at(spent, p["type"]), F.lit(0))).cast("long").alias("tokens")))
    t = t.select("conv_id", "turn", "role", "order", content.alias("content"), F.filter(F.transform("parts", record), lambda x: x.isNotNull()).alias("attachments"))
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(SAYS))
    t = t.withColumn("piece", F.concat(head, "content", F.lit(CLOSE))).withColumn("head", F.length(head))
    t = t.withColumn("rank", F.row_number().over(line)).withColumn("before", F.coalesce(F.sum(F.length("piece")).over(earlier), F.lit(0)))
    t = t.withColumn("span", F.when(F.col("role") == "assistant", F.struct(F.col("rank").alias("turn"), (F.col("head") + 1).alias("at"), (F.col("before") + F.col("head") + 1).alias("start"), F.length("content").alias("length"))))
    grouped = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("rank", "piece", "span", "attachments"))).alias("all"))
    return grouped.select(
        "conv_id",
        F.array_join(F.transform("all", lambda x: x["piece"]), "").alias("formatted"),
        F.filter(F.transform("all", lambda x: x["span"]), lambda x: x.isNotNull()).alias("loss_spans"),
        F.flatten(F.transform("all", lambda x: x["attachments"])).alias("attachments"),
    ).withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]))


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns, texts and masked texts, from the output alone: adds pieces, roles, texts, loss_text."""
    body = F.split("formatted", "</s>", -1)
    f = formatted.withColumn("pieces", F.slice(body, F.lit(1), F.size(body) - 1))
    said = lambda x: F.substring_index(F.substr(x, F.lit(len(OPEN) + 1)), SAYS, 1)
    rest = lambda x: F.substr(x, F.length(said(x)) + len(OPEN) + len(SAYS) + 1)
    f = f.withColumn("roles", F.transform("pieces", lambda x: unescape(said(x)))).withColumn("texts", F.transform("pieces", lambda x: unescape(rest(x))))
    return f.withColumn("loss_text", F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr(F.element_at("pieces", s["turn"]), s["at"], s["length"]))), ""))


def digests(formatted: DataFrame) -> DataFrame:
    f = read_back(formatted)
    turns = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit("\n"), t, F.lit("\n"))), "")
    return f.select(
        "conv_id",
        F.size("pieces").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.size("attachments").cast("long").alias("n_attachments"),
        F.col("attachment_tokens"),
    )


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations and one more, -1, whose texts are control strings."""
    spark = conversations.sparkSession
    rows = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return conversations.select("conv_id", "turn", "role", "text").unionByName(rows)


CHAT_SQL = """
with rows as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(17 + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;')) + length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;')))::bigint as formatted_chars,
  0::bigint as n_attachments, 0::bigint as attachment_tokens
from rows group by conv_id
"""
