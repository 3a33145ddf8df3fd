"""Column functions on text: sentences, names, quotes, JSON answers."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..vocabulary import ENTITY_TYPES, RELATION_LABELS, UNDIRECTED_LABELS


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of c, with c computed once however often f reads it and wherever Spark moves the whole: aliases of costly columns are
    put in for their names, each time, by filters that move before them."""
    return F.transform(F.array(c), f)[0]


def strip(c: Column) -> Column:
    """Without white space at either end; Spark's trim knows blanks only."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


# Where sentences and paragraphs end, and a fenced answer.
SENTENCE_END = r"(?U)(?<=[.!?])\s+(?=[A-Z])"
PARAGRAPH_END = r"\n\n+"
FENCED = r"(?s)```(?:json)?\s*(\{.*?\})\s*```"


def split_sentences(c: Column) -> Column:
    """Parts between . ! or ? and a capital, without outer white space; empty ones dropped."""
    return F.filter(F.transform(F.split(c, SENTENCE_END), strip), lambda x: x != "")


def split_paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, PARAGRAPH_END), strip), lambda x: x != "")


def estimate_tokens(c: Column) -> Column:
    n = F.char_length(c)
    return F.when(n.isNull() | (n == 0), 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("int")


def full_text(title: Column, abstract: Column) -> Column:
    return F.concat_ws("\n\n", title, F.nullif(abstract, F.lit("")))


def author_names(authors: Column) -> Column:
    return F.filter(F.transform(authors, lambda a: a["name"]), lambda n: n != "")


def relative_offset(offset: Column, start: Column, end: Column) -> Column:
    return F.when((offset >= start) & (offset < end), offset - start)


def absolute_offset(offset: Column, start: Column, end: Column) -> Column:
    return F.when((offset >= 0) & (offset < end - start), offset + start)


def normalize_name(c: Column) -> Column:
    """Lower case, single blanks, and neither white space nor punctuation at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)\s+", " "), r"(?U)^[\s\p{Punct}]+|[\s\p{Punct}]+$", "")


def quote_hash(c: Column) -> Column:
    return F.sha2(strip(c), 256)


def packed(c: str | Column) -> Column:
    """An id as binary, for exchanges: 64 hexadecimal digits, as digests have, take 32 bytes; any other text follows 33 zeros.
    `unpacked` gives the id back."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.rlike(r"\A[0-9a-f]{64}\z"), F.unhex(c)).otherwise(F.concat(F.lit(bytes(33)), c.cast("binary")))


def unpacked(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.octet_length(c) == 32, F.lower(F.hex(c))).otherwise(F.substring(c, 34, 2**31 - 1).cast("string"))


def spared(c: str | Column, usual: Column) -> Column:
    """c packed, for exchanges, and null where it is what usually follows from its row: `restored` makes it again behind them."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c == usual, F.lit(None).cast("binary")).when(c.isNull(), F.lit(b"")).otherwise(packed(c))


def restored(c: str | Column, usual: Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNull(), usual).when(F.octet_length(c) > 0, unpacked(c))


def exact_match(quote: Column, text: Column) -> Column:
    return F.contains(text, quote) | F.contains(F.lower(text), F.lower(quote))


def locate_quote(quote: Column, text: Column) -> Column:
    """struct(start, end) of a quote: exact, else without case, else nulls. An empty quote is at 0."""
    at = F.coalesce(F.nullif(F.instr(text, quote), F.lit(0)), F.nullif(F.instr(F.lower(text), F.lower(quote)), F.lit(0))) - 1
    return F.struct(at.cast("int").alias("start"), (at + F.char_length(quote)).cast("int").alias("end"))


def _squash(c: Column) -> Column:
    return F.translate(F.lower(strip(c)), " _/", "")


def _lookup(key: Column, pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))[key] if pairs else F.lit(None).cast("string")


def match_entity_type(c: Column, types: Sequence[str] = ENTITY_TYPES) -> Column:
    """The vocabulary's spelling: equal without case, else without blanks, _ and / too; null if there is none."""
    exact = _lookup(F.lower(strip(c)), {t.lower(): t for t in types})
    return F.coalesce(exact, _lookup(_squash(c), {t.lower().replace("/", "").replace(" ", "").replace("_", ""): t for t in types}))


def match_relation_label(c: Column, labels: Sequence[str] = RELATION_LABELS) -> Column:
    return _lookup(F.translate(F.upper(strip(c)), " -", "__"), {x: x for x in labels})


def is_directional(label: Column, undirected: Sequence[str] = UNDIRECTED_LABELS) -> Column:
    return ~label.isin(*undirected)


def extract_json(c: Column) -> Column:
    """The object in a fenced block, else from the first { to the last }, else the text."""
    found = lambda pattern, group, other: let(F.regexp_extract(c, pattern, group), lambda x: F.when(x != "", x).otherwise(other))
    return found(FENCED, 1, found(r"(?s)\{.*\}", 0, c))


def is_json(c: Column) -> Column:
    return F.try_parse_json(c).isNotNull()


def mend_json(c: Column) -> Column:
    """Commas that models leave out or put too many. Most patterns need a line's end, so text of one line skips them."""

    def applied(c: Column, patterns) -> Column:
        for pattern, by in patterns:
            c = F.regexp_replace(c, pattern, by)
        return c

    # Pattern and replacement, applied in turn; none of the first makes a new line.
    anywhere = ((r",\s*([}\]])", "$1"), (r"\}\s*\{", "},{"))
    between = ((r'"\s*\n\s*"', '",\n"'), (r'(\d)\s*\n\s*"', '$1,\n"'), (r'\}\s*\n\s*"', '},\n"'))
    return let(applied(c, anywhere), lambda x: F.when(F.contains(x, F.lit("\n")), applied(x, between)).otherwise(x))


def close_json(c: Column) -> Column:
    """JSON that was cut off, closed behind the last complete object that another one follows."""
    cut = F.char_length(c) - F.instr(F.reverse(c), ",}")  # characters before the comma of the last "},"
    return F.when(F.instr(c, "},") <= 1, c).otherwise(F.concat(F.substring(c, F.lit(1), cut), F.lit("]}")))


def repair_json(c: Column) -> Column:
    """Mended, and closed if that is still no JSON."""
    c = mend_json(c)
    return F.when(is_json(c), c).otherwise(close_json(c))
