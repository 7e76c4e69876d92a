"""Scalar text expressions: all built-in functions, so they stay inside code generation where it applies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ligatures and what they stand for.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}
# What may be glued to the end of the contents entry before it.
GLUED = (r"Appendix\s+[A-Z]\b", r"References\b", r"Index\b", r"Contents\s+[ivxlcdm]+\b")
# Running heads within a contents line.
HEADS = (r"(?<=\d)[ivxlcdm]+\s*CONTENTS\b", r"\b[ivxlcdm]+\s*CONTENTS\b", r"\s*CONTENTS\s+[ivxlcdm]+\b")
# An entry of a table of contents, and marks of continued titles. Pages of up to five digits may have blanks in
# them; longer ones are one piece after a blank or a leader, so they are never cut.
ENTRY = (
    r"^(\d+(?:\.\d+)*|Appendix\s+[A-Z]|Exercises|References|Index|Preface|Mathematical notation)\b"
    r"\s*(.*?)\s*(?:[:.]\s*)?((?:\d\s*){1,5}|(?<=[\s.:])\d{6,9}|[ivxlcdm]+)\s*$"
)
CONTINUED = r"\s*[\(\[\-–—]+\s*(?:continued|cont\.?|cont'd|part\s*\d+)\s*[\)\]]?\s*$"
# Letters with one diacritic that the full-text tokeniser folds.
FOLD_FROM = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćĉċčďēĕėęěĝğġģĥĩīĭįĵķĺļľńņňōŏőŕŗřśŝşšţťũūŭůűųŵŷźżž"
FOLD_TO = "aaaaaaceeeeiiiinooooouuuuyyaaaccccdeeeeegggghiiiijklllnnnooorrrssssttuuuuuuwyzzz"

QUERY_TERMS = 64
TOKEN = r"[\p{L}\p{N}]+"
# Words that don't count as overlap.
STOPWORDS = (
    "a an the of to in on for and or is are was were be been being this that these those "
    "what which who whom how why when where does do did how it its as by with from at into "
    "than then so such can could would should may might will shall has have had not no"
).split()


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: Column | str, fold: bool = False) -> Column:
    """Index tokens: lower-case runs of letters and digits; optionally with single diacritics folded."""
    low = F.lower(F.coalesce(col(text), F.lit("")))
    return F.regexp_extract_all(F.translate(low, FOLD_FROM, FOLD_TO) if fold else low, F.lit(TOKEN), F.lit(0))


def query_terms(question: Column | str, limit: int = QUERY_TERMS) -> Column:
    """Distinct words of two characters or more, first come first, `limit` at most."""
    words = F.regexp_extract_all(F.lower(F.coalesce(col(question), F.lit(""))), F.lit(r"(?U)\w+"), F.lit(0))
    return F.slice(F.array_distinct(F.filter(words, lambda t: F.length(t) >= 2)), 1, limit)


def match_query(question: Column | str) -> Column:
    """The terms quoted and joined with OR; null without a term."""
    terms = query_terms(question)
    quoted = F.array_join(F.transform(terms, lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR ")
    return F.when(F.size(terms) > 0, quoted)


def breadcrumb(titles: Column | str) -> Column:
    """Non-empty titles from the root down, joined with ' > '."""
    return F.array_join(F.filter(col(titles), lambda t: t != ""), " > ")


def embed_text(title, crumb, summary, body, body_chars: int = 0) -> Column:
    """What is embedded for a node: its filled headings and, if asked for, the head of its body; else the title."""
    filled = lambda c: F.nullif(F.trim(col(c)), F.lit(""))
    parts = [filled(title), filled(crumb), filled(summary)]
    if body_chars > 0:
        parts.append(F.nullif(F.trim(F.substring(F.coalesce(col(body), F.lit("")), 1, body_chars)), F.lit("")))
    joined = F.concat_ws("\n", *parts)
    return F.when(joined != "", joined).otherwise(F.coalesce(col(title), F.lit("")))


def truncated(text: Column | str, n: int) -> Column:
    """Null if n is 0 or less; the text if it fits; else its first n characters, right-trimmed, and '...'."""
    if n <= 0:
        return F.lit(None).cast("string")
    t = F.coalesce(col(text), F.lit(""))
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, n)), F.lit("...")))


def estimated_tokens(text: Column | str) -> Column:
    """A quarter of the characters, rounded up."""
    return F.floor((F.length(F.coalesce(col(text), F.lit(""))) + 3) / 4).cast("long")


def without_ligatures(text: Column | str) -> Column:
    out = F.coalesce(col(text), F.lit(""))
    for k, v in LIGATURES.items():
        out = F.replace(out, F.lit(k), F.lit(v))
    return out


def title_key(text: Column | str) -> Column:
    """Letters a-z and digits only, for finding a title in a page."""
    return F.regexp_replace(F.lower(without_ligatures(text)), "[^a-z0-9]+", "")


# How much of a page is searched for a title, and how late in it, in letters and digits, a title may begin.
PAGE_WINDOW, LATEST = 1500, 160


def page_key(page: Column | str, window: int = PAGE_WINDOW) -> Column:
    """Letters a-z and digits of a page's head."""
    return title_key(F.substring(F.coalesce(col(page), F.lit("")), 1, window))


def title_at_start(title: Column | str, page: Column | str, window: int = PAGE_WINDOW, latest: int = LATEST) -> Column:
    """'yes' if the title begins near the page's start, 'no' if later, null if it is not in the window at all."""
    t, p = title_key(title), page_key(page, window)
    at = F.position(t, p)
    return F.when((t == "") | (p == "") | (at == 0), F.lit(None).cast("string")).when(at - 1 <= latest, "yes").otherwise("no")


def dots_to_colon(text: Column | str) -> Column:
    """Dot leaders, tight or spaced, become a colon."""
    return F.regexp_replace(F.regexp_replace(col(text), r"\.{5,}", ": "), r"(?:\. ){5,}\.?", ": ")


def toc_text(text: Column | str) -> Column:
    """Contents text without ligatures, with glued entries on lines of their own."""
    out = without_ligatures(text)
    for mark in GLUED:
        out = F.regexp_replace(out, rf"(?i)(?<=[0-9ivxlcdm])(?={mark})", "\n")
    return out


def toc_line(text: Column | str) -> Column:
    """A contents line without running heads and with white space squeezed."""
    out = F.trim(col(text))
    for mark in HEADS:
        out = F.regexp_replace(out, "(?i)" + mark, "")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def toc_title(text: Column | str) -> Column:
    """A contents title without dot leaders, a trailing colon and stray blanks; a lone capital rejoins its word."""
    out = F.regexp_replace(col(text), r"(?:\s*\.\s*){2,}", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"\s*:\s*$", ""), r"\s+", " ")
    return F.regexp_replace(F.btrim(out, F.lit(" .:")), r"\b([A-Z])\s+([a-z][a-z]+)\b", "$1$2")


def toc_page(text: Column | str) -> Column:
    """The page number, if it is one once blanks are gone; Roman and other marks are null."""
    t = F.regexp_replace(col(text), r"\s+", "")
    return F.when(t.rlike("^[0-9]{1,9}$"), t.try_cast("int"))


def without_continuation(title: Column | str) -> Column:
    """A title without up to three trailing marks such as (Continued), - cont'd or - Part 2."""
    out = F.coalesce(col(title), F.lit(""))
    for _ in range(3):
        out = F.rtrim(F.regexp_replace(out, "(?i)" + CONTINUED, ""))
    return out


def matching_title(title: Column | str) -> Column:
    """Titles that differ by continuation marks, white space or case only share this."""
    return F.lower(F.trim(F.regexp_replace(without_continuation(title), r"\s+", " ")))


def physical_index(tag: Column | str) -> Column:
    """The number in <physical_index_N>, physical_index_N or plain digits."""
    t = col(tag).cast("string")
    return F.coalesce(F.nullif(F.regexp_extract(t, r"physical_index_(\d{1,9})", 1), F.lit("")).try_cast("int"), t.try_cast("int"))


def tag_range(text: Column | str) -> tuple[Column, Column]:
    """Smallest and largest number of all physical_index tags in a text."""
    found = F.transform(F.regexp_extract_all(col(text), F.lit(r"physical_index_(\d{1,9})"), F.lit(1)), lambda x: x.try_cast("int"))
    return F.array_min(found), F.array_max(found)


def parent_code(code: Column | str) -> Column:
    """A dotted section code without its last part; null at the top."""
    return F.nullif(F.regexp_extract(col(code), r"^(.*)\.[^.]+$", 1), F.lit(""))


def code_prefixes(code: Column | str) -> Column:
    """Proper prefixes of a dotted code, nearest first."""
    parts = F.split(col(code), r"\.")
    ups = F.when(F.size(parts) > 1, F.sequence(F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.transform(ups, lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))


def node_id(seq: Column | str) -> Column:
    """A number padded to four digits, wider if need be."""
    t = col(seq).cast("string")
    return F.lpad(t, F.greatest(F.lit(4), F.length(t)), F.lit("0"))


def auto_depth(nodes: Column | str) -> Column:
    """How deep a structure of that many nodes is shown by default; null: all."""
    n = col(nodes)
    return F.when(n > 500, 1).when(n > 200, 2).when(n > 80, 3)


def file_stem(path: Column | str) -> Column:
    return F.regexp_replace(F.element_at(F.split(col(path), "/"), -1), r"\.[^.]*$", "")


def safe_name(name: Column | str) -> Column:
    """A file name: '/' becomes '-', and nothing becomes Untitled."""
    return F.coalesce(F.nullif(F.replace(col(name), F.lit("/"), F.lit("-")), F.lit("")), F.lit("Untitled"))


def line_count(text: Column | str) -> Column:
    t = F.coalesce(col(text), F.lit(""))
    return (F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1).cast("long")


def question_text(answer: Column | str) -> Column:
    """A drafted question: the JSON field, else the first filled line without its label and quotes."""
    t = F.trim(col(answer))
    first = F.get(F.filter(F.split(t, "\n"), lambda x: F.trim(x) != ""), 0)
    plain = F.btrim(F.regexp_replace(F.trim(first), r"(?i)^question\s*:\s*", ""), F.lit("\"' "))
    return F.nullif(F.trim(F.coalesce(F.get_json_object(F.when(t.startswith("{"), t), "$.question"), plain)), F.lit(""))


def provider(model: Column | str) -> Column:
    """Which service a model name is routed to when none is asked for."""
    m = F.coalesce(col(model), F.lit(""))
    out = F.when(m == "", "openai")
    for name in ("ollama", "vllm", "openai", "litellm"):
        out = out.when(m.startswith(name + "/"), name)
    return out.when(m.contains("/"), "litellm").otherwise("openai")


def word_overlap(question: Column | str, passage: Column | str) -> Column:
    """Share of a question's distinct words, common ones aside, that the passage holds; 0 without any."""
    stop = F.array(*map(F.lit, STOPWORDS))
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))
    q, p = F.array_except(words(question), stop), words(passage)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, p)) / F.size(q)).otherwise(F.lit(0.0))


def score_label(rerank, rrf, score) -> Column:
    """How a candidate's score is shown: the most refined there is."""
    return (
        F.when(col(rerank).isNotNull(), F.format_string("rerank=%.3f", col(rerank)))
        .when(col(rrf).isNotNull(), F.format_string("rrf=%.4f", col(rrf)))
        .otherwise(F.format_string("score=%.3f", col(score)))
    )
