"""Column functions on texts: masking, fingerprints, citations, normal forms, stable ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is masked, in this order, each on the text that the earlier ones left.
PII = {
    "API_KEY": r"\b(?:sk|pk|rk)-[A-Za-z0-9_-]{16,}",
    "JWT": r"\beyJ[\w-]{5,}\.eyJ[\w-]{5,}\.[\w-]*",
    "ACCOUNT": r"(?<![\w-])\d{20}(?![\w-])",
    "SNILS": r"\b\d{3}-\d{3}-\d{3}[\s-]\d{2}\b",
    "EMAIL": r"(?<![\w.+-])[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}\b",
    "PHONE_RU": r"(?<!\w)(?:\+7|8)[\s\-]?\(?\d{3}\)?[\s\-]?\d{3}[\s\-]?\d{2}[\s\-]?\d{2}\b",
    "CARD": r"\b(?:\d{4}[\s\-]?){3}\d{4}\b",
    "INN": r"(?<![\w-])(?:\d{10}|\d{12})(?![\w-])",
    "PASSPORT": r"\b\d{2}\s?\d{2}\s?\d{6}\b",
}
#: What every match of these has: texts without it, most of all, need no other pattern.
PII_SIGNS = r"[@\p{Nd}]|eyJ|[spr]k-[A-Za-z0-9_-]{16}"
# Keys of log rows that are never masked.
TECHNICAL_KEYS = ("timestamp", "level", "logger", "request_id", "trace_id", "prompt_hash")
# Fixed value: the form of a citation.
CITATION = r"\[(\d{1,2}(?:\s*[,;]\s*\d{1,2})*)\]"
# The refusal, how one begins, and a line of sources that names none.
NO_ANSWER = "По базе не нашёл, могу эскалировать."
NO_ANSWER_HEAD = "по базе не нашёл"
EMPTY_SOURCES = r"\s*Источники:\s*\.?\s*$"
# Words that carry no meaning in a search.
STOPWORDS = (
    "и в во на с со к ко по за из у о об а но или не ни ли же бы то это как что где когда почему зачем мне меня мой моя мои я "
    "вы вас ваш есть для от до при так уже можно нужно подскажите пожалуйста здравствуйте если"
).split()
# Fixed value: the endings that are cut off.
ENDINGS = "аеиоуыэюяйь"
#: Categories of tickets and the wordings that name them.
TICKETS = {"FAQ": ("faq", "частый вопрос", "частые вопросы"), "тех. проблема": ("тех проблема", "техпроблема", "техническая проблема", "технический сбой"), "жалоба": ("жалоба",), "прочее": ("прочее", "другое")}
# Text prefixes of embedding models, by the first pattern that a model's name holds.
PREFIXES = (
    (r"(?i)e5-(large-)?instruct|e5-mistral", "Instruct: Given a web search query, retrieve relevant passages that answer the query\nQuery: ", ""),
    (r"(?i)(^|[/_:-])(multilingual-)?e5([-_.:]|$)", "query: ", "passage: "),
    (r"(?i)frida|rosberta", "search_query: ", "search_document: "),
    (r"(?i)nomic-embed", "search_query: ", "search_document: "),
    (r"(?i)embeddinggemma", "task: search result | query: ", "title: none | text: "),
)


def masked(text: Column) -> Column:
    """The text with personal data replaced by [LABEL]; Unicode-aware."""
    found = text
    for label, pattern in PII.items():
        found = F.regexp_replace(found, "(?U)" + pattern, f"[{label}]")
    return F.when(text.rlike(PII_SIGNS), found).otherwise(text)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value made once however often it is named."""
    return F.transform(F.array(value), then)[0]


def _counted(label: str, pattern: str) -> Callable[[Column], Column]:
    return lambda s: F.struct(F.regexp_replace(s["t"], pattern, f"[{label}]").alias("t"), F.concat(s["n"], F.array(F.regexp_count(s["t"], F.lit(pattern)))).alias("n"))


def masked_counts(text: Column) -> Column:
    """A map of label to number of replacements, each counted at its own step."""
    state = F.struct(text.alias("t"), F.array().cast("array<int>").alias("n"))
    for label, pattern in PII.items():
        state = _let(state, _counted(label, "(?U)" + pattern))
    labels = F.array(*map(F.lit, PII))
    return F.when(text.rlike(PII_SIGNS) | text.isNull(), F.map_from_arrays(labels, state["n"])).otherwise(F.map_from_arrays(labels, F.array_repeat(F.lit(0), len(PII))))


def preview(text: Column) -> Column:
    """The first 120 characters of the masked first 480."""
    return F.substring(masked(F.substring(text, 1, 480)), 1, 120)


def fingerprint(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def masked_map(row: Column) -> Column:
    """A log row with all values masked but those of technical keys."""
    return F.transform_values(row, lambda k, v: F.when(k.isin(*TECHNICAL_KEYS), v).otherwise(masked(v)))


def clean(text: Column) -> Column:
    """Unix line ends, plain spaces, none at line ends, at most one blank line, none around."""
    text = F.translate(F.regexp_replace(text, "\r\n?", "\n"), " ", " ")
    text = F.regexp_replace(text, r"[ \t\x0B\f]+(?=\n|\z)", "")
    return F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"\A[\s]+|[\s]+\z", "")


def clean_upload(text: Column) -> Column:
    """The text without control, format, private and surrogate characters, but with line ends and tabs."""
    return F.regexp_replace(text, r"[\p{Cc}\p{Cf}\p{Co}\p{Cs}&&[^\n\t]]", "")


def truncated(text: Column, limit: int) -> Column:
    """The start of a text of at most `limit` tokens of four UTF-8 bytes; a letter that doesn't fit whole is left out."""
    raw, most = F.encode(text, "UTF-8"), max(limit, 0) * 4

    def within(at: int) -> Column:  # whether the byte is inside a letter
        return F.hex(F.substring(raw, at, 1)).between("80", "BF")

    end = F.when(~within(most + 1), most).when(~within(most), most - 1).when(~within(most - 1), most - 2).otherwise(most - 3) if most else F.lit(0)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.decode(F.substring(raw, F.lit(1), end), "UTF-8"))


def shortened(text: Column, limit: int) -> Column:
    """A text of at most `limit` letters, cut at the last space in the last tenth (at the limit, where there is none), with a note of what is shown."""
    head = F.substring(text, 1, limit)
    back = F.instr(F.reverse(F.substring(head, int(limit * 0.9) + 1, limit)), " ")
    cut = F.when(back > 0, limit - back).otherwise(F.lit(limit))
    note = F.concat(F.lit("\n[…текст обрезан: показано "), cut.cast("string"), F.lit(" из "), F.char_length(text).cast("string"), F.lit(" символов]"))
    return F.when(F.char_length(text) <= limit, text).otherwise(F.concat(F.regexp_replace(F.substring(text, F.lit(1), cut), r"(?U)\s+\z", ""), note))


def category_of(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, parts[0]).otherwise("general")


def version_of(name: Column) -> Column:
    """The version in a file's name, null if there is none: rules_v2.3.pdf has 2.3."""
    stem = F.regexp_replace(F.regexp_replace(name, r"\.failed$", ""), r"\.(pdf|docx|html|htm|md|txt)$", "")
    return F.nullif(F.regexp_extract(stem, r"(?i)[_-]v(\d+(?:\.\d+)*)$", 1), F.lit(""))


def file_of(doc_id: Column) -> Column:
    return F.substring_index(doc_id, "#", 1)


def iso_date(text: Column) -> Column:
    """The date of ISO text or of a PDF's D:YYYYMMDD, as ISO text; null for anything else."""
    pdf = F.regexp_replace(F.regexp_extract(F.trim(text), r"^D:(\d{8})", 1), r"(\d{4})(\d{2})(\d{2})", "$1-$2-$3")
    iso = F.date_format(F.try_to_date(F.substring(F.trim(text), 1, 10), "yyyy-MM-dd"), "yyyy-MM-dd")
    return F.coalesce(F.nullif(pdf, F.lit("")), iso)


def utc(text: Column) -> Column:
    """RFC 3339 text in UTC with Z; null if it can't be read.  The session's time zone must be UTC."""
    return F.date_format(F.try_to_timestamp(text), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def uuid5(namespace: str, name: Column) -> Column:
    """The name's version 5 UUID in the namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    digit = F.element_at(F.array(*map(F.lit, "89ab")), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4) + 1)
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(digit, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def cache_key(*parts: Column) -> Column:
    """SHA-256 of the parts as a JSON array of strings, with a comma and a space between them."""
    quoted = [F.regexp_extract(F.to_json(F.array(p)), r"(?s)^\[(.*)\]$", 1) for p in parts]
    return F.sha2(F.concat(F.lit("["), F.concat_ws(", ", *quoted), F.lit("]")), 256)


def cited(answer: Column, count: Column) -> Column:
    """Numbers in [1] or [1, 3] from 1 to count, sorted, once each."""
    groups = F.regexp_extract_all(answer, F.lit(CITATION), F.lit(1))
    numbers = F.flatten(F.transform(groups, lambda g: F.regexp_extract_all(g, F.lit(r"\d{1,2}"), F.lit(0))))
    return F.array_sort(F.array_distinct(F.filter(F.transform(numbers, lambda n: n.cast("int")), lambda n: (n >= 1) & (n <= count))))


def without_citations(text: Column) -> Column:
    text = F.regexp_replace(text, r"\s*Источники:\s*(?:" + CITATION + r"[\s,;]*)+\.?\s*$", "")
    text = F.regexp_replace(text, r"[ \t]*" + CITATION, "")
    return F.regexp_replace(F.regexp_replace(text, r"[ \t]+([.,;:!?])", "$1"), r"\A\s+|\s+\z", "")


def with_sources_line(answer: Column, number: Column, count: Column) -> Column:
    """The answer with a line that names source `number` (`operators.evaluation.best_overlap`; null: none), unless it cites one of `count` or refuses."""
    settled = (F.trim(answer) == "") | is_refusal(answer) | (F.size(cited(answer, count)) > 0) | number.isNull() | (count < 1)
    body = F.regexp_replace(F.regexp_replace(answer, r"(?U)\s+\z", ""), EMPTY_SOURCES, "")
    return F.when(settled, answer).otherwise(F.concat(body, F.lit("\n\nИсточники: ["), number.cast("string"), F.lit("]")))


def sources_suffix(answer: Column, number: Column, count: Column) -> Column:
    """What has to follow an answer that was sent already, so that it names source `number`; empty where nothing has to."""
    settled = (F.trim(answer) == "") | is_refusal(answer) | (F.size(cited(answer, count)) > 0) | number.isNull() | (count < 1)
    ref = F.concat(F.lit("["), number.cast("string"), F.lit("]"))
    gap = F.when(F.endswith(answer, F.lit("\n\n")), "").when(F.endswith(answer, F.lit("\n")), "\n").otherwise("\n\n")
    return F.when(settled, "").when(answer.rlike(EMPTY_SOURCES), F.concat(F.lit(" "), ref)).otherwise(F.concat(gap, F.lit("Источники: "), ref))


def final_answer(answer: Column, phrase: str = NO_ANSWER) -> Column:
    """answer, confident: the trimmed answer, or the refusal where it is empty or refuses itself."""
    own = F.regexp_replace(answer, r"(?U)\A\s+|\s+\z", "")
    refused = (F.coalesce(own, F.lit("")) == "") | is_refusal(own)
    return F.struct(F.when(refused, phrase).otherwise(own).alias("answer"), (~refused).alias("confident"))


def is_refusal(answer: Column, phrase: str = NO_ANSWER_HEAD) -> Column:
    return F.contains(F.translate(F.lower(answer), "ё", "е"), F.lit(phrase.lower().replace("ё", "е")))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.lower(text), "ё", "е"), F.lit(r"(?U)\w+"), F.lit(0))


def stem(word: Column) -> Column:
    cut = F.rtrim(word, F.lit(ENDINGS))
    return F.substring(F.when(cut == "", word).otherwise(cut), 1, 5)


def terms(text: Column) -> Column:
    """The distinct stems of a text's words but stop words, longer than one letter."""
    kept = F.filter(words(text), lambda w: ~w.isin(*STOPWORDS))
    return F.array_distinct(F.filter(F.transform(kept, stem), lambda s: F.char_length(s) > 1))


def answer_terms(text: Column) -> Column:
    """Words of four letters or more, cut to five, and numbers."""
    low = F.translate(F.lower(text), "ё", "е")
    long = F.transform(F.regexp_extract_all(low, F.lit(r"(?U)[^\W\d_]{4,}"), F.lit(0)), lambda w: F.substring(w, 1, 5))
    return F.array_union(long, F.regexp_extract_all(low, F.lit(r"\d+"), F.lit(0)))


def ticket_category(text: Column) -> Column:
    """The category whose wording comes first in the text as whole words; the last one if there is none."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.translate(F.lower(text), "ё", "е"), r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))
    found = []
    for order, (category, wordings) in enumerate(TICKETS.items()):
        for wording in wordings:
            at = F.regexp_instr(plain, F.lit(rf"(?U)(?<!\w){wording}(?!\w)"))
            found.append(F.when(at > 0, F.struct(at.alias("at"), F.lit(order).alias("order"), F.lit(category).alias("category"))))
    return F.coalesce(F.array_min(F.array_compact(F.array(*found)))["category"], F.lit("прочее"))


def json_object(text: Column) -> Column:
    """The text of the JSON object in a model's answer: in a fenced block, or from the first { to the last }."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json|JSON)?\s*(.*?)```", 1)
    candidate = F.when(F.trim(fenced) != "", fenced).otherwise(text)
    return F.nullif(F.regexp_extract(candidate, r"(?s)(\{.*\})", 1), F.lit(""))


def with_prefix(model: Column, text: Column, query: bool) -> Column:
    prefix = F.lit("")
    for pattern, of_query, of_document in reversed(PREFIXES):
        prefix = F.when(model.rlike(pattern), of_query if query else of_document).otherwise(prefix)
    return F.concat(prefix, text)


def clean_query(text: Column, chars: int = 300) -> Column:
    """A rewritten question: the first line with text, without its label and quotes; null if nothing is left."""
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    line = F.coalesce(F.get(lines, F.lit(0)), F.lit(""))
    line = F.regexp_replace(line, r"(?iu)^(самостоятельный вопрос:|вопрос:)\s*", "")
    line = F.trim(F.regexp_replace(line, "^[«»\"'“”„ ]+|[«»\"'“”„ ]+$", ""))
    return F.nullif(F.substring(line, 1, chars), F.lit(""))


def for_quotes(text: Column) -> Column:
    """Lower case, every run of white space one space: how quotes are compared."""
    return F.lower(F.trim(F.regexp_replace(F.translate(text, "  ", "  "), r"\s+", " ")))


def for_keywords(text: Column) -> Column:
    """Lower case, ё as е, all dashes alike: how keywords are compared."""
    return F.translate(F.lower(text), "ё ‐‑‒–—−", "е ------")
