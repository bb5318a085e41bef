"""Fields read from decision texts, questions and answers, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import digits_only, normalize, squash, text

# Outcome labels by code, and the patterns that give a code, in order of priority.
OUTCOMES = ("", "indeferido", "deferido", "parcialmente deferido", "não conhecido", "extinto", "diligência")
OUTCOME_PATTERNS = (
    (5, r"EXTINT[OA]|PERDA\s+DO\s+OBJETO"),
    (4, r"NAO\s+(?:SE\s+)?CONHEC"),
    (3, r"PARCIALMENTE\s+DEFERID|DEFIRO\s+PARCIALMENTE|DEFIRO\s+EM\s+PARTE|PARCIAL\s+PROVIMENTO|DEFERIMENTO\s+PARCIAL"),
    (1, r"INDEFIR|INDEFERID|NEGO\s+PROVIMENTO|NEGAR\s+PROVIMENTO|IMPROCEDENTE"),
    (2, r"\bDEFIR|\bDEFERID|DOU\s+PROVIMENTO|DAR\s+PROVIMENTO|\bPROCEDENTE"),
    (6, r"DILIGENCIA"),
)
OUTCOME_MARK, OUTCOME_WINDOW = "DISPOSITIVO DA DECIS", 700
# Months in order, for dates in words.
MONTHS = "janeiro fevereiro marco abril maio junho julho agosto setembro outubro novembro dezembro"
SESSION_DATE = r"(?iu)SESS[ÃA]O[^\n]{0,60}?(\d{2})/(\d{2})/(20\d{2})"
WORDED_DATE = (
    r"(?iu)\b(\d{1,2})\s+de\s+(janeiro|fevereiro|mar[çc]o|abril|maio|junho|julho|agosto|setembro|outubro|novembro|dezembro)"
    r"\s+de\s+(20\d{2})"
)
PANEL = r"(?iu)Junta Integrada de Julgamento Fiscal\s*(?:-\s*)?([IV]+|\d)\b|JIJFI-?\s*([IV]+)\b"
OPERATIVE = (
    r"(?iu)DISPOSITIVO|ANTE O EXPOSTO|DIANTE DO EXPOSTO|PELO EXPOSTO|POR TODO O EXPOSTO|ISTO POSTO|DESTA FORMA, (?:DEFIRO|INDEFIRO)|"
    r"\bVOTO\b\s*\n|CONCLUS[ÃA]O\s*\n"
)
REASONING = r"(?ium)\bFUNDAMENTA[ÇC][ÃA]O\b|\bDO M[ÉE]RITO\b|^M[ÉE]RITO\b|\bVOTO\s*(?:DO RELATOR)?\s*$|\bAN[ÁA]LISE\b"
SIGNATURE = r"Belo Horizonte,|Relator\(a\)\s*$|_{5,}"
QUANTITATIVE = (
    r"quant[oa]s|percent|porcent|propor|taxa|estatistic|frequen|maioria|costuma|tendencia|geralmente|"
    r"normalmente|chance|probab|em geral|com que frequencia"
)
OPINION_ASKED = r"(?iu)parecer|orienta|dilu|gesle|nota orientativa"
NOTICE_ID, LONG_ID = r"\b\d{8,14}\s?[A-Za-z]{2}\b", r"\d[\d./_-]{9,}\d"
SECOND_INSTANCE, FIRST_INSTANCE = r"\b(2a|2|segunda)\s+instancia|\bccf\b|conselho", r"\b(1a|1|primeira)\s+instancia"
INSPECTOR = r"(?ius)considera[çc][õo]es fiscais\s*:?\s*(.+?)(?:Em sua defesa|FUNDAMENTA[ÇC][ÃA]O|$)"
NOTICE_NUMBER = r"\b\d{8,14}[A-Z]{2}\b"


def _all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def last(c: Column, n: int) -> Column:
    """The last n characters."""
    return F.right(c, F.lit(n))


def outcome_code(c: Column | str) -> Column:
    """Code read in the window after the last operative mark; 0 if there is none."""
    # The greedy start finds the last mark.
    window = F.regexp_extract(F.upper(normalize(c)), rf"(?s)^.*({OUTCOME_MARK}.{{0,{OUTCOME_WINDOW - len(OUTCOME_MARK)}}})", 1)
    code = F.lit(0)
    for number, pattern in reversed(OUTCOME_PATTERNS):
        code = F.when(window.rlike(pattern), F.lit(number)).otherwise(code)
    return code


def outcome(c: Column | str) -> Column:
    return F.element_at(F.array(*map(F.lit, OUTCOMES)), outcome_code(c) + 1)


def session_date(c: Column | str, protocol: Column | str | None = None) -> Column:
    """yyyy-mm-dd of the first plausible date: session lines near the start, then dates in words near
    the end; the year lies between the protocol's and 2030; '' if none. Days aren't validated."""
    t = text(c)
    least = F.regexp_extract(text(protocol if protocol is not None else F.lit("")), r"(20\d{2})\D{0,2}\d{2}\s*$", 1)
    least = F.when(least == "", "2000").otherwise(least)
    head, tail = F.left(t, F.lit(1500)), last(t, 2500)
    numeric = F.transform(
        F.arrays_zip(_all(head, SESSION_DATE, 3), _all(head, SESSION_DATE, 2), _all(head, SESSION_DATE, 1)),
        lambda x: F.concat_ws("-", x["0"], x["1"], x["2"]),
    )
    month = lambda m: F.lpad(F.array_position(F.array(*map(F.lit, MONTHS.split())), normalize(m)).cast("string"), 2, "0")
    worded = F.transform(
        F.arrays_zip(_all(tail, WORDED_DATE, 3), _all(tail, WORDED_DATE, 2), _all(tail, WORDED_DATE, 1)),
        lambda x: F.concat_ws("-", x["0"], month(x["1"]), F.lpad(x["2"], 2, "0")),
    )
    good = F.filter(F.concat(numeric, worded), lambda d: (F.substring(d, 1, 4) >= least) & (F.substring(d, 1, 4) <= "2030") & F.substring(d, 6, 2).between("01", "12"))
    return F.coalesce(F.get(good, F.lit(0)), F.lit(""))


def panel(c: Column | str) -> Column:
    """Panel number near the start; roman I to V as a digit."""
    head = F.left(text(c), F.lit(1500))
    found = F.upper(F.concat(F.regexp_extract(head, PANEL, 1), F.regexp_extract(head, PANEL, 2)))
    roman = F.array_position(F.array(*map(F.lit, ("I", "II", "III", "IV", "V"))), found)
    return F.when(roman > 0, roman.cast("string")).otherwise(found)


def clean_subject(c: Column | str) -> Column:
    """The request alone: cut at header words, leading protocol dropped, squashed, 300 characters."""
    cut = F.get(F.split(text(c), r"\bAUTUADO\(S\)|\bCPF/CNPJ|\bREPRESENTANTE"), F.lit(0))
    return F.substring(squash(F.regexp_replace(cut, r"^\s*\d{2}\.[\d./_-]+\s*", "")), 1, 300)


def operative_part(clean: Column | str) -> Column:
    """From the last conclusion mark, if past 40 % of the cleaned text, else its last 700 characters;
    900 at most; cut at the signature if that stands after the 40th character."""
    t = text(clean)
    before = F.length(F.regexp_extract(t, rf"(?s)^(.*)(?:{OPERATIVE})", 1))
    found = t.rlike(OPERATIVE)
    start = F.when(found & (before > F.length(t) * 0.4), before).otherwise(F.greatest(F.length(t) - 700, F.lit(0)))
    part = squash(t.substr(start + 1, F.lit(900)))
    sign = F.length(F.regexp_extract(part, rf"(?s)^(.*?)(?:{SIGNATURE})", 1))
    return F.when(part.rlike(SIGNATURE) & (sign > 40), F.trim(F.left(part, sign))).otherwise(part)


def reasoning_start(passages: Column | str) -> Column:
    """Place of the first passage, from a quarter of them on, that begins the reasoning; -1 if none."""
    p = F.col(passages) if isinstance(passages, str) else passages
    marked = F.transform(p, lambda x, i: F.when((i >= F.floor(F.size(p) / 4)) & F.left(x, F.lit(200)).rlike(REASONING), i))
    return F.coalesce(F.array_min(marked), F.lit(-1))


def instance_label(code: Column | str) -> Column:
    return F.when(text(code) == "2a_instancia", "2ª instância").otherwise("1ª instância")


def notice_refs(question: Column | str) -> Column:
    """Notice numbers named in a question, upper case without spaces, in order."""
    return F.transform(_all(text(question), NOTICE_ID), lambda x: F.upper(F.replace(x, F.lit(" "), F.lit(""))))


def digit_refs(question: Column | str) -> Column:
    """Long runs of digits and separators as digits, in order: protocols, else notices."""
    return F.transform(_all(text(question), LONG_ID), lambda x: F.regexp_replace(x, r"\D", ""))


def question_filters(question: Column | str) -> Column:
    """struct(instance, year): null where the question sets none. Ids are blanked first; a year counts
    only if exactly one is written."""
    plain = normalize(F.regexp_replace(text(question), f"{LONG_ID}|{NOTICE_ID}", " "))
    years = _all(plain, r"\b(20[12]\d)\b", 1)
    return F.struct(
        F.when(plain.rlike(SECOND_INSTANCE), "2ª").when(plain.rlike(FIRST_INSTANCE), "1ª").alias("instance"),
        F.when(F.size(years) == 1, F.get(years, F.lit(0))).alias("year"),
    )


def is_quantitative(question: Column | str) -> Column:
    return normalize(question).rlike(QUANTITATIVE)


def asks_opinion(question: Column | str) -> Column:
    return text(question).rlike(OPINION_ASKED)


def inspector_narrative(c: Column | str) -> Column:
    """What the inspector considered, notice numbers removed, 600 characters."""
    return F.left(F.regexp_replace(F.regexp_extract(text(c), INSPECTOR, 1), NOTICE_NUMBER, ""), F.lit(600))


def answer_citations(answer: Column | str, n_sources: Column) -> Column:
    """struct(cited, invalid): distinct numbers in brackets, rising; thinking blocks are dropped first."""
    bare = F.trim(F.regexp_replace(text(answer), r"(?s)<think>.*?</think>\s*", ""))
    numbers = F.array_sort(F.array_distinct(F.transform(_all(bare, r"\[(\d{1,2})\]", 1), lambda n: n.cast("int"))))
    good = lambda n: (n >= 1) & (n <= n_sources)
    return F.struct(F.filter(numbers, good).alias("cited"), F.filter(numbers, lambda n: ~good(n)).alias("invalid"))


def protocol_digits(c: Column | str) -> Column:
    return digits_only(c)
