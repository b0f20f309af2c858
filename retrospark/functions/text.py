"""Text expressions; all of them are built-in Spark expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's str.strip() takes off.
WHITE_SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"
EDGE_MARKS = ".,!?;:"


def _folding() -> tuple[str, str]:
    """Letters whose canonical decomposition is one base letter with marks, and the base; then marks, which have none."""
    pairs = []
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        base = unicodedata.normalize("NFD", c)
        if len(base) > 1 and all(unicodedata.combining(x) for x in base[1:]):
            pairs.append((c, base[0]))
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


_FROM, _TO = _folding()
MARKS = "".join(map(chr, range(0x300, 0x370)))


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(WHITE_SPACE))


def fold_accents(c: Column) -> Column:
    return F.translate(c, _FROM + MARKS, _TO)


def index_terms(c: Column) -> Column:
    """Lower-cased runs of letters and digits without accents: how texts are indexed."""
    return F.regexp_extract_all(fold_accents(F.lower(c)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def normalize_separators(c: Column) -> Column:
    return strip(F.regexp_replace(c, "[-_]", " "))


def query_tokens(c: Column) -> Column:
    """White-space separated words without marks at their edges."""
    words = F.filter(F.split(c, r"\s+"), lambda w: w != "")
    return F.transform(words, lambda w: F.trim(w, F.lit(EDGE_MARKS)))


def contains_any(c: Column, markers: list[str]) -> Column:
    """Whether a marker occurs anywhere, in lower case."""
    return F.lower(c).rlike("|".join(re.escape(m) for m in markers))


def contains_any_word(c: Column, markers: list[str]) -> Column:
    """As contains_any, but only whole words count."""
    return F.lower(c).rlike(r"(?U)(?<!\w)(?:" + "|".join(re.escape(m) for m in markers) + r")(?!\w)")


def relevant_section(text: Column, markers: list[str], window: int = 1500) -> Column:
    """The text around its earliest marker (of equals, the first in alphabet), with dots where it is cut."""
    half = window // 2
    low = F.lower(text)
    first = F.array_min(F.filter(F.array(*[F.instr(low, m) for m in markers]), lambda p: p > 0))
    start = F.greatest(F.lit(0), first - 1 - half)
    end = F.least(F.length(text), first - 1 + half)
    section = strip(F.substr(text, start + 1, end - start))
    section = F.concat(F.when(start > 0, "...").otherwise(""), section, F.when(end < F.length(text), "...").otherwise(""))
    return F.when(first.isNotNull(), section).otherwise(F.substr(text, F.lit(1), F.lit(window)))


def let(value: Column, then) -> Column:
    """then(value), with the value computed once, as Spark computes what stands in a lambda each time that it is named."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def chunk_text(text: Column, size: int = 1500, overlap: int = 200) -> Column:
    """Overlapping pieces of at most `size` characters, cut at the last blank line where that is beyond a third.

    Each step takes a piece off the front and carries the rest of the text, null when there is none.
    """
    least = size // 3 + 1 - overlap
    steps = F.sequence(F.lit(1), F.ceil(F.length(text) / least).cast("int") + 1)

    def end_of(window: Column, more: Column) -> Column:
        back = F.instr(F.reverse(window), "\n\n")
        return let(F.when(more, back).otherwise(0), lambda b: F.when((b > 0) & (size - 1 - b > size // 3), size - 1 - b).otherwise(size))

    def step(a: Column, _: Column) -> Column:
        rest = a["rest"]
        taken = let(F.substr(rest, F.lit(1), F.lit(size)), lambda w: let(end_of(w, F.length(rest) > size), lambda end: F.struct(end.cast("int").alias("end"), strip(F.substr(w, F.lit(1), end)).alias("piece"))))
        after = lambda t: F.struct(F.when(F.length(rest) > t["end"], F.substr(rest, t["end"] - overlap + 1)).alias("rest"), F.when(t["piece"] != "", F.array_append(a["out"], t["piece"])).otherwise(a["out"]).alias("out"))
        return F.when(rest.isNull(), a).otherwise(let(taken, after))

    start = F.struct(text.alias("rest"), F.array().cast("array<string>").alias("out"))
    return F.when(F.length(text) <= size, F.array(text)).otherwise(F.aggregate(steps, start, step, lambda a: a["out"]))


def highlight(text: Column, terms: list[str], before: str = "**`", after: str = "`**") -> Column:
    """Every occurrence of a term, in any case, between two marks."""
    real = [t for t in terms if t]
    if not real:
        return text
    pattern = "(?iu)(" + "|".join(re.escape(t) for t in real) + ")"
    safe = lambda s: s.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(text, pattern, f"{safe(before)}$1{safe(after)}")


def highlight_terms(query: str, expanded: list[str]) -> list[str]:
    words = [w.strip(EDGE_MARKS) for w in query.lower().split()]
    return sorted({w for w in words if len(w) >= 2} | {e.lower() for e in expanded}, key=lambda t: (-len(t), t))


def slug(c: Column) -> Column:
    plain = F.regexp_replace(F.lower(c), r"(?U)[^\w\s-]", "")
    return F.trim(F.substr(F.regexp_replace(plain, r"(?U)\s+", "-"), F.lit(1), F.lit(40)), F.lit("-"))


def project_label(directory: Column) -> Column:
    parts = F.filter(F.split(directory, "-"), lambda p: (p != "") & (p != "Users"))
    short = F.when(F.length(directory) > 0, F.substr(directory, F.lit(1), F.lit(30))).otherwise("unknown")
    return F.when(F.size(parts) >= 2, F.array_join(F.slice(parts, -2, 2), "/")).otherwise(short)


def text_hash(text: Column, model: str, dimensions: int) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(model), F.lit(str(dimensions)), text), 256)


def parse_timestamp(c: Column) -> Column:
    """ISO text as a timestamp, UTC where it names no zone; null if it isn't one."""
    good = c.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?(Z|[+-]\d{2}:?\d{2})?)?$")
    return F.when(good, F.try_to_timestamp(F.replace(c, F.lit(","), F.lit("."))))


def age_label(ts: Column, as_of: Column) -> Column:
    seconds = F.floor((F.unix_micros(as_of) - F.unix_micros(ts)) / 1_000_000)
    days = F.floor(seconds / 86_400)
    hours = F.floor((seconds - days * 86_400) / 3600)
    label = F.when(days > 30, F.concat(F.lit("ha "), F.floor(days / 30), F.lit("m"))).when(days > 0, F.concat(F.lit("ha "), days, F.lit("d"))).when(hours > 0, F.concat(F.lit("ha "), hours, F.lit("h"))).otherwise("agora")
    return F.when(ts.isNull(), "").otherwise(label)


def score_bar(score: Column, width: int = 10) -> Column:
    filled = F.greatest(F.lit(0), F.least(F.lit(width), (score * width).cast("int")))
    return F.concat(F.repeat(F.lit("▓"), filled), F.repeat(F.lit("░"), width - filled))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Ends of a term in its grams, and characters up to which a term's places fit in a long.
FIRST, LAST, PLACES = "\x02", "\x03", 62


def grams(c: Column) -> Column:
    """Neighbouring characters of a term, its ends included: one more than it has characters."""
    padded = F.concat(F.lit(FIRST), c, F.lit(LAST))
    return F.transform(F.sequence(F.lit(1), F.length(c) + 1), lambda i: F.substr(padded, i, F.lit(2)))


def grams_of(term: str) -> list[str]:
    """grams() of one term."""
    padded = FIRST + term + LAST
    return [padded[i : i + 2] for i in range(len(term) + 1)]


def shared_grams(a_size: Column, b_size: Column, cut: float) -> Column:
    """How many grams of a are in b at least, where indel_ratio reaches `cut`.

    Of a common subsequence of n characters and the two ends, n + 1 pairs follow one another; each of the (a - n) characters
    that only a has, and of the (b - n) that only b has, parts one of them at most. Without an effect (0 or less) for
    cuts up to 66.6.
    """
    both = a_size + b_size
    return 3 * F.ceil(both * cut / 200 - 1e-9) - both + 1


def letter_masks(a: Column) -> Column:
    """For each character of a, of PLACES characters at most, the places where it stands as bits of a long."""
    chars = F.split(a, "")
    places = lambda c: F.aggregate(F.sequence(F.lit(1), F.length(a)), F.lit(0).cast("long"), lambda m, i: m.bitwiseOR(F.when(F.substr(a, i, F.lit(1)) == c, F.call_function("shiftleft", F.lit(1).cast("long"), i - 1)).otherwise(F.lit(0).cast("long"))))
    return F.map_from_entries(F.transform(F.array_distinct(chars), lambda c: F.struct(c, places(c))))


def common_subsequence(a: Column, b: Column, masks: Column | None = None) -> Column:
    """Length of the longest common subsequence: all of a's places in one long, a step for each character of b. Longer ones
    go by a row of lengths. masks: letter_masks(a), where it is there already."""
    masks = letter_masks(a) if masks is None else masks
    zero = F.lit(0).cast("long")
    full = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(a)) - 1

    def step(row: Column, c: Column) -> Column:
        # The places of c that are still free: the lowest of each run of them is taken.
        free = row.bitwiseAND(F.coalesce(F.try_element_at(masks, c), zero))
        return (row + free).bitwiseOR(row - free).bitwiseAND(full)

    short = F.length(a) - F.bit_count(F.aggregate(F.split(b, ""), full, step))
    places = F.sequence(F.lit(1), F.length(a))
    nothing = F.array_repeat(F.lit(0), F.length(a) + 1)

    def row_after(row: Column, c: Column) -> Column:
        grown = lambda out, i: F.array_append(out, F.greatest(F.element_at(row, i + 1), F.element_at(out, -1), F.element_at(row, i) + (F.substr(a, i, F.lit(1)) == c).cast("int")))
        return F.aggregate(places, F.array(F.lit(0)), grown)

    long = F.element_at(F.aggregate(F.split(b, ""), nothing, row_after), -1)
    return F.when((a == "") | (b == ""), 0).when(F.length(a) <= PLACES, short).otherwise(long)


def indel_ratio(a: Column, b: Column, masks: Column | None = None) -> Column:
    """200 * LCS / (len a + len b): similarity with insertions and deletions only."""
    both = F.length(a) + F.length(b)
    return F.when(both == 0, 100.0).otherwise(200.0 * common_subsequence(a, b, masks) / both)
