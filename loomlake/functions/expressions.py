"""Column expressions shared by the operators; every one stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that a CSV reader takes for missing.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
# Words that say nothing in a catalog question.
STOP_WORDS = tuple(
    """the a an is are was were be been being have has had do does did will would could should may might can shall must need
    i you he she it we they me him her us my your his its our their this that these those what which who whom how where when why
    if then else than so as and or but not no nor in on at to for with by from of about into through between after before above below
    all each every both few more most some any tell show give get find list describe explain mean means called used using across
    layer layers column columns table tables view views data bronze silver gold schema database pipeline type name value values description""".split()
)
PUNCTUATION = "'\"`()[]{}!@#$%^&*"
# Phrases that decide how much work a question needs; the first list is tested first.
DEEP_PHRASES = ("compare", "trace", "end-to-end", "explain how", "relationship between", "impact", "all layers", "difference between", "why", "analyze")
FAST_PHRASES = ("what is", "what does", "list", "describe", "show me", "what are", "how many", "what's")


def finite(c: Column) -> Column:
    """The value, or null where it is NaN or infinite."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def na_to_null(c: Column) -> Column:
    return F.when(~c.isin(*NA_TOKENS), c)


def full_name(first: Column, last: Column) -> Column:
    """Null where either part is null."""
    return F.concat(first, F.lit(" "), last)


def iso_date(c: Column) -> Column:
    """A date written yyyy-mm-dd that exists, else null."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c.try_cast("date"))


def age_years(born: Column, as_of: str) -> Column:
    """Whole years of 365.25 days up to ``as_of``, truncated toward zero; null for no date."""
    return (F.date_diff(F.lit(as_of).cast("date"), iso_date(born)) / F.lit(365.25)).cast("int")


def ratio(a: Column, b: Column) -> Column:
    """a / b; null for a zero or null denominator."""
    return F.try_divide(a, b)


def text_length(c: Column, parity: bool = False) -> Column:
    """Length of the text form; with ``parity`` a null counts as the text ``None``, else it is left out."""
    t = c.cast("string")
    return F.length(F.coalesce(t, F.lit("None")) if parity else t)


def without_first(c: Column, prefix: str) -> Column:
    """The text without the first occurrence of ``prefix``, wherever it is."""
    return F.regexp_replace(c, rf"^(.*?){prefix}", "$1")


def titled(c: Column) -> Column:
    """Underscores to spaces, words capitalised."""
    return F.initcap(F.translate(c, "_", " "))


def singular(c: Column) -> Column:
    """Capitalised, without any trailing s."""
    return F.regexp_replace(titled(c), "s+$", "")


def last_part(c: Column) -> Column:
    return F.substring_index(c, ".", -1)


def chunk_key(collection: Column, document: Column) -> Column:
    """Chunks are the same if their collection and first 100 characters are."""
    return F.concat(collection, F.lit(":"), F.substring(document, 1, 100))


def id_text(*parts: Column) -> Column:
    """Parts joined by ``_``, spaces to ``_``."""
    return F.translate(F.concat_ws("_", *parts), " ", "_")


def contains_ignoring_spaces(text: Column, part: Column) -> Column:
    return F.contains(F.lower(F.translate(text, " ", "")), F.lower(F.translate(part, " ", "")))


def any_of(text: Column, phrases: tuple[str, ...]) -> Column:
    cond = F.lit(False)
    for p in phrases:
        cond = cond | F.contains(text, F.lit(p))
    return cond


def route(question: Column) -> Column:
    """``deep`` for questions that need joining facts, ``fast`` for look-ups, ``deep`` for the rest; null for null."""
    q = F.lower(question)
    return F.when(q.isNull(), None).when(any_of(q, DEEP_PHRASES), "deep").when(any_of(q, FAST_PHRASES), "fast").otherwise("deep")


def question_tokens(question: Column) -> Column:
    """Distinct candidate identifiers of a question: no stop words, numbers or single characters; each also in lower case."""
    raw = F.split(F.trim(F.regexp_replace(question, "[,?.]", " ")), r"[ \t\r\n]+")
    clean = F.transform(raw, lambda t: F.btrim(t, F.lit(PUNCTUATION)))
    kept = F.filter(clean, lambda t: (F.length(t) > 1) & ~t.rlike(r"^\p{Nd}+$") & ~F.lower(t).isin(*STOP_WORDS))
    return F.array_distinct(F.concat(kept, F.transform(kept, F.lower)))


def cited_numbers(answer: Column) -> Column:
    """Distinct chunk numbers cited as [n]; numbers too long for an integer come out as null."""
    return F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.try_cast("int")))


def invalid_citations(answer: Column, chunks: Column) -> Column:
    return F.array_sort(F.filter(cited_numbers(answer), lambda n: n.isNull() | (n < 1) | (n > chunks)))


def quality_band(scores: Column) -> Column:
    """HIGH, MEDIUM or LOW by the mean of the first three scores; NONE without scores."""
    top = F.slice(scores, 1, 3)
    mean = F.aggregate(top, F.lit(0.0), lambda a, x: a + x) / F.size(top)
    return F.when(F.coalesce(F.size(scores), F.lit(0)) <= 0, "NONE").when(mean > 0.6, "HIGH").when(mean > 0.3, "MEDIUM").otherwise("LOW")


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def preview(c: Column, width: int = 40) -> Column:
    return F.when(F.length(c) > width, F.concat(F.substring(c, 1, width - 3), F.lit("..."))).otherwise(c)


def pseudonym(prefix: str, *parts: Column) -> Column:
    """A stable physical name: prefix and eight hex digits of a hash of the logical name."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.concat_ws(".", *parts), 256), 1, 8))


def dtype_label(kind: str) -> str:
    """The type labels of a profile."""
    return {"string": "object", "double": "float64", "float": "float32", "int": "int64", "bigint": "int64", "smallint": "int64", "tinyint": "int64", "boolean": "bool"}.get(
        kind, "datetime64[ns]" if kind.startswith(("timestamp", "date")) else "object"
    )


def split_once(c: Column, separator: str) -> Column:
    """The parts before and after the first separator; one part where there is none."""
    at = F.instr(c, separator)
    return F.when(at > 0, F.array(F.substring(c, F.lit(1), at - 1), F.substring(c, at + len(separator), F.length(c)))).otherwise(F.array(c))


def fenced_json(c: Column) -> Column:
    """A JSON object in an answer, with or without a code fence or words around it, as a map of texts; null where there is none."""
    bare = F.regexp_replace(c, r"```(?:json)?", "")
    return F.from_json(F.nullif(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), F.lit("")), "map<string,string>")


def utc_stamp(c: Column) -> Column:
    """yyyy-mm-ddThh:mm:ssZ in the session's zone, which is to be UTC."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def short_id(*parts: Column) -> Column:
    """Eight hex digits that depend on the parts alone."""
    return F.substring(F.sha2(F.concat_ws("\u0001", *parts), 256), 1, 8)


def without_fields(df, names: tuple[str, ...]):
    """Drop columns of these names, and fields of these names in structs and arrays of structs, at any depth."""
    from pyspark.sql.types import ArrayType, StructType

    def cut(col: Column, kind):
        if isinstance(kind, StructType):
            kept = [cut(col.getField(f.name), f.dataType).alias(f.name) for f in kind.fields if f.name not in names]
            return F.when(col.isNotNull(), F.struct(*kept)) if kept else F.lit(None).cast("string")
        if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType | ArrayType):
            return F.transform(col, lambda x: cut(x, kind.elementType))
        return col

    return df.select(*[cut(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields if f.name not in names])
