"""JSON-lines sources: decisions, technical opinions and statutes, to item rows.

Missing values are empty strings, as every later step expects. id is the row's place in its file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..functions import extract as X
from ..functions.text import capitalize, digits_only, offence_key, strip_extension, terms, text
from ..operators.chunk import TARGETS, clean_lines, paragraphs_of_text, passages, topics
from .stored import stored

NOTICE = "struct<numero:string,tipo:string,infracao:string,dispositivo_legal_transgredido:string,lei:string>"
DECISIONS = f"file_id string, nome_arquivo string, protocolo string, assunto string, instancia string, texto string, drive_view_url string, autos array<{NOTICE}>"
OPINIONS = "file_id string, nome_arquivo string, categoria string, texto string, drive_view_url string"
STATUTES = (
    "categoria string, texto string, riscado array<array<int>>, drive_view_url string, dispositivos array<struct<"
    "tipo:string,rotulo:string,contexto:string,numero:string,inicio:int,fim:int,revogado:boolean>>"
)
# The guidance document among the opinions, and the year of its current edition.
GUIDANCE_NAME, GUIDANCE_YEAR = r"(?i)^ENTENDIMENTO JUNTAS", "2024"
# Notes on amendments, and how a line of law begins.
NOTE = r"(?iu)\b(com reda[çc][ãa]o dada|acrescentad[oa]|revogad[oa]) (pel[oa]|por)\b"
LAW_LINE = r"^\s*(Art\.?|§|[IVXLC]+|[a-z])\s*\S*\s*[-–)]"
#: A unit of law is kept from this many characters.
LEAST_UNIT = 30


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON-lines files under a fixed schema, with a dense id: by file name, then by line. Blank
    lines are no rows; a line that is no record is a row of nulls."""
    return with_ordinal(spark.read.schema(T._parse_datatype_string(schema)).json(path))


def with_ordinal(df: DataFrame, name: str = "id") -> DataFrame:
    """A dense row number over a scan of files: by file, then by place.

    One scan is stored with each row's split (file and start) and its place there. Rows before a split
    in its file, and before a file, are sums over a table of one row a split, which is joined by split;
    a scan cut in other splits gives the same numbers.
    """
    rows = stored(df.select("*", F.input_file_name().alias("__file"), F.input_file_block_start().alias("__start"), F.monotonically_increasing_id().alias("__at")))
    splits = rows.groupBy("__file", "__start").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    in_file = Window.partitionBy("__file").orderBy("__start").rowsBetween(Window.unboundedPreceding, -1)
    files = splits.groupBy("__file").agg(F.sum("__n").alias("__all"))
    # One row for each file: this window is small even where the rows aren't.
    ahead = files.select("__file", F.coalesce(F.sum("__all").over(Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__ahead"))
    places = splits.withColumn("__before", F.coalesce(F.sum("__n").over(in_file), F.lit(0))).join(ahead, "__file").select("__file", "__start", "__first", (F.col("__before") + F.col("__ahead")).alias("__base"))
    out = rows.join(places, ["__file", "__start"])
    return out.select(*df.columns, (F.col("__base") + F.col("__at") - F.col("__first")).alias(name))


def decisions(raw: DataFrame) -> DataFrame:
    """Item rows of decisions: fields, passages and the terms that are indexed.

    raw: DECISIONS and id. keys: distinct offence keys; names: (key, name) in order of the notices.
    """
    r = raw.select(
        "id", text("file_id").alias("file_id"), F.lit("decision").alias("kind"), text("nome_arquivo").alias("title"), text("protocolo").alias("protocol"),
        X.clean_subject("assunto").alias("subject"), X.instance_label("instancia").alias("instance"), text("texto").alias("text"),
        F.coalesce("autos", F.array().cast(f"array<{NOTICE}>")).alias("notices"), text("drive_view_url").alias("link"),
    ).withColumn("lines", clean_lines("text"))
    named = lambda a: F.coalesce(a["infracao"], F.lit("")) != ""
    indexed = F.concat_ws(" ", F.flatten(F.transform("notices", lambda a: F.array(F.coalesce(a["infracao"], F.lit("")), F.coalesce(a["dispositivo_legal_transgredido"], F.lit(""))))))
    r = r.withColumns({
        "outcome": X.outcome("text"), "date": X.session_date("text", "protocol"), "panel": X.panel("text"),
        "operative": X.operative_part(F.array_join(F.filter("lines", lambda x: x != ""), "\n")),
        "passages": passages("lines", TARGETS["decision"]),
        "names": F.transform(F.filter("notices", named), lambda a: F.struct(offence_key(a["infracao"]).alias("key"), F.trim(a["infracao"]).alias("name"))),
        "terms": terms(F.concat_ws(" ", "subject", indexed, "text")),
    })
    return r.withColumns({"year": F.substring("date", 1, 4), "reasoning": X.reasoning_start("passages"), "keys": F.array_distinct(F.col("names.key"))}).drop("lines", "text")


def reference_ids(items: DataFrame) -> DataFrame:
    """(kind, key, id): notices by number and by digits, protocols by digits; each once."""
    notices = items.select("id", F.explode("notices.numero").alias("n")).where("n <> ''")
    return (
        notices.select(F.lit("notice").alias("kind"), F.upper("n").alias("key"), "id")
        .union(notices.select(F.lit("notice"), digits_only("n"), "id"))
        .union(items.where("protocol <> ''").select(F.lit("protocol"), digits_only("protocol"), "id")).distinct()
    )


def offence_names(items: DataFrame) -> DataFrame:
    """(key, name, n): the first name seen for each key, and how many decisions have the key."""
    named = items.select("id", F.posexplode("names").alias("pos", "x"))
    return named.groupBy(F.col("x.key").alias("key")).agg(F.min_by("x.name", F.struct("id", "pos")).alias("name"), F.count_distinct("id").alias("n"))


def opinions(raw: DataFrame) -> DataFrame:
    """One row per passage of each opinion; guidance documents are left out."""
    kept = raw.where(~text("nome_arquivo").rlike(GUIDANCE_NAME)).withColumn("parts", passages(clean_lines("texto"), TARGETS["opinion"]))
    rows = kept.select("id", "file_id", "nome_arquivo", "categoria", "drive_view_url", F.size("parts").alias("n"), F.posexplode("parts").alias("pos", "passage"))
    return rows.select(
        F.struct("id", "pos").alias("at"), text("file_id").alias("file_id"), F.lit("opinion").alias("kind"),
        F.concat(strip_extension("nome_arquivo"), F.lit(" ("), text("categoria"), F.lit(", parte "), F.col("pos") + 1, F.lit("/"), F.col("n"), F.lit(")")).alias("title"),
        F.array("passage").alias("passages"), text("drive_view_url").alias("link"), terms(F.concat_ws(" ", text("nome_arquivo"), "passage")).alias("terms"),
    )


def guidance(raw: DataFrame, override: DataFrame | None = None) -> DataFrame:
    """One row per topic of the current guidance document (the last in file order), or of an override.

    override: (paragraphs array, link) of a document that replaces the corpus's own.
    """
    if override is None:
        own = raw.where(text("nome_arquivo").rlike(GUIDANCE_NAME) & F.col("nome_arquivo").contains(GUIDANCE_YEAR))
        override = own.agg(F.max_by(F.struct("texto", "drive_view_url"), "id").alias("d")).where("d is not null").select(paragraphs_of_text("d.texto").alias("paragraphs"), text("d.drive_view_url").alias("link"))
    # The current document is one row.
    override = override.withColumn("document", F.lit(0))
    rows = topics(override, key="document").join(F.broadcast(override.select("document", "link").limit(1)), "document")
    rows = rows.select(F.col("pos").cast("long").alias("id"), F.concat(F.lit("guidance#"), "pos").alias("file_id"), F.lit("guidance").alias("kind"), "title", "link", passages(clean_lines("body"), TARGETS["guidance"]).alias("passages"))
    own_name = F.element_at(F.split("title", " › "), -1)
    return rows.withColumn("terms", terms(F.concat_ws(" ", own_name, "title", F.array_join("passages", " "))))


def without_struck(c: Column | str, struck: Column, start: Column, stop: Column) -> Column:
    """Characters start..stop of a text less the struck intervals, without amendment notes."""
    t = text(c)
    state = F.struct(start.alias("pos"), F.lit("").alias("out"))

    def skip(s: Column, iv: Column) -> Column:
        a, b = F.get(iv, F.lit(0)), F.get(iv, F.lit(1))
        kept = t.substr(s["pos"] + 1, F.greatest(a - s["pos"], F.lit(0)))
        return F.when((b <= s["pos"]) | (a >= stop), s).otherwise(F.struct(F.greatest(s["pos"], b).alias("pos"), F.concat(s["out"], kept).alias("out")))

    kept = F.aggregate(
        F.array_sort(F.coalesce(struck, F.array().cast("array<array<int>>"))), state, skip,
        lambda s: F.concat(s["out"], t.substr(s["pos"] + 1, F.greatest(stop - s["pos"], F.lit(0)))),
    )
    lines = F.filter(F.split(kept, "\n"), lambda x: ~is_note(x))
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")


def is_note(line: Column) -> Column:
    """A note on an amendment, not law: it says so, holds no table bar and doesn't begin like law."""
    return line.rlike(NOTE) & ~line.contains("|") & ~line.rlike(LAW_LINE)


def statutes(raw: DataFrame) -> DataFrame:
    """One row per article or annex item in force."""
    u = F.col("u")
    rows = raw.select("id", "categoria", "texto", "riscado", "drive_view_url", F.posexplode("dispositivos").alias("pos", "u"))
    rows = rows.where(~F.coalesce(u["revogado"], F.lit(False)) & u["tipo"].isin("artigo", "item")).withColumn("body", without_struck("texto", F.col("riscado"), u["inicio"], u["fim"]))
    rows = rows.where(F.length("body") >= LEAST_UNIT).withColumn("passages", passages(clean_lines("body"), TARGETS["statute"]))
    title = F.concat(text("categoria"), F.lit(", "), text(u["rotulo"]))
    return rows.select(
        F.struct("id", "pos").alias("at"), F.concat(text("categoria"), F.lit("#"), text(u["rotulo"])).alias("file_id"), F.lit("statute").alias("kind"), title.alias("title"), text(u["contexto"]).alias("subject"),
        text("drive_view_url").alias("link"), "passages", u["tipo"].alias("unit"), text("categoria").alias("law"), text(u["numero"]).alias("number"),
        terms(F.concat_ws(" ", title, text(u["contexto"]), F.array_join("passages", " "))).alias("terms"),
    )


def articles(units: DataFrame) -> DataFrame:
    """(cited, at): the first unit of each article of a numbered law, by struct(kind, num, art)."""
    from ..functions.citations import law_kind, law_number

    a = units.where((F.col("unit") == "artigo") & F.col("law").contains(" "))
    cited = F.struct(law_kind(F.substring_index("law", " ", 1)).alias("kind"), law_number(F.regexp_replace("law", r"^\S+ ", "")).alias("num"), F.col("number").alias("art"))
    return a.select(cited.alias("cited"), "at").groupBy("cited").agg(F.min("at").alias("at"))


def header(kind: str = "kind") -> Column:
    """The record's header text, written from its fields."""
    k = F.col(kind)
    n = F.size("notices")
    parts = F.concat_ws(
        " · ", F.when(F.col("protocol") != "", F.concat(F.lit("Protocolo "), "protocol")).otherwise(F.concat(F.lit("Arquivo "), F.left("title", F.lit(80)))),
        F.when(F.col("instance") != "", F.col("instance")), F.when(F.col("panel") != "", F.concat(F.lit("JIJF "), "panel")),
        F.when(F.col("date") != "", F.concat(F.lit("sessão de "), F.array_join(F.reverse(F.split("date", "-")), "/"))),
        F.concat(F.lit("resultado: "), F.when(F.col("outcome") != "", F.col("outcome")).otherwise("não identificado")),
    )
    line = lambda a: F.concat(
        F.lit("Auto "), F.coalesce(a["numero"], F.lit("")), F.lit(": "), capitalize(F.trim(F.coalesce(a["infracao"], F.lit("")))),
        F.when(F.coalesce(a["dispositivo_legal_transgredido"], F.lit("")) != "", F.concat(F.lit(" ("), F.trim(a["dispositivo_legal_transgredido"]), F.lit(")"))).otherwise(""),
    )
    decision = F.array_join(F.concat(
        F.array(parts), F.when(F.col("subject") != "", F.array(F.concat(F.lit("Assunto: "), "subject"))).otherwise(F.array().cast("array<string>")),
        F.transform(F.slice("notices", 1, 4), line), F.when(n > 4, F.array(F.concat(F.lit("(+"), n - 4, F.lit(" autos)")))).otherwise(F.array().cast("array<string>")),
    ), "\n")
    return (
        F.when(k == "guidance", F.concat(F.lit("ENTENDIMENTO DAS JUNTAS (Vade Mecum de jurisprudência administrativa, 2024): "), "title"))
        .when(k == "statute", F.concat(F.lit("LEGISLAÇÃO (texto vigente): "), "title", F.when(F.col("subject") != "", F.concat(F.lit(" ("), "subject", F.lit(")"))).otherwise("")))
        .when(k == "opinion", F.concat(F.lit("PARECER TÉCNICO: "), "title")).otherwise(decision)
    )
