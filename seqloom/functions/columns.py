"""Scalar and array expressions over sequences, regions and masks. All take and return Columns; nulls give nulls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Residue letters in the alignment tools' order with their codes. B counts as D, J and O as X, U as C, Z as E.
RESIDUES = "ACDEFGHIKLMNPQRSTVWYX-"
RESIDUE_ALIASES = {"B": "D", "J": "X", "O": "X", "U": "C", "Z": "E"}
# The internal order of the same residues.
INTERNAL_ORDER = "ARNDCQEGHILKMFPSTWYVX-"
# The seven regions of a variable domain with what surrounds them.
REGIONS = ["FR1", "CDR1", "FR2", "CDR2", "FR3", "CDR3", "FR4"]


def chars(text: Column) -> Column:
    """The characters of a text; an empty text has none."""
    return F.when(F.length(text) > 0, F.split(text, "")).when(text.isNotNull(), F.array().cast("array<string>"))


def _total(array: Column, of, start="int") -> Column:
    return F.aggregate(array, F.lit(0).cast(start), lambda acc, x: acc + of(x))


def popcount_hamming(a: Column, b: Column) -> Column:
    """Sum over positions of the differing bits of the code points; null for unequal lengths."""
    bits = F.zip_with(chars(a), chars(b), lambda x, y: F.bit_count(F.ascii(x).bitwiseXOR(F.ascii(y))))
    return F.when(F.length(a) == F.length(b), _total(bits, lambda x: x))


def symbol_hamming(a: Column, b: Column) -> Column:
    """Positions with different symbols; null for unequal lengths."""
    return F.when(F.length(a) == F.length(b), _total(F.zip_with(chars(a), chars(b), lambda x, y: (x != y).cast("int")), lambda x: x))


def weighted_hamming(a: Column, b: Column, weights: Column) -> Column:
    """Sum of the weights of differing positions; weights is an array as long as the texts."""
    differ = F.zip_with(chars(a), chars(b), lambda x, y: (x != y).cast("double"))
    return F.when(F.length(a) == F.length(b), _total(F.zip_with(differ, weights, lambda d, w: d * w), lambda x: x, "double"))


#: Short ASCII texts as numbers: seven characters a word, so that sums of bytes never meet the sign, and so many words.
PACK_CHARS, PACK_WORDS = 7, 5
_LOW, _HIGH = (sum(b << 8 * k for k in range(PACK_CHARS)) for b in (0x7F, 0x80))


def fits_packed(text: Column) -> Column:
    """Whether packed() holds the text whole: ASCII of at most 35 characters."""
    return (F.length(text) == F.octet_length(text)) & (F.length(text) <= PACK_CHARS * PACK_WORDS)


def packed(text: Column) -> list[Column]:
    """The characters as bytes of PACK_WORDS long numbers, filled up with blanks; only for texts with fits_packed()."""
    part = lambda k: F.rpad(F.substring(text, PACK_CHARS * k + 1, PACK_CHARS), PACK_CHARS, " ")
    return [F.conv(F.hex(part(k)), 16, 10).cast("long") for k in range(PACK_WORDS)]


#: Texts of capital letters alone (and the five other characters of their block) as numbers: five bits tell them apart.
LETTER_CHARS, LETTER_WORDS = 12, 3
_LETTERS, _DIGITS = "@ABCDEFGHIJKLMNOPQRSTUVWXYZ[\\]^_", "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def fits_letters(text: Column) -> Column:
    """Whether packed_letters() holds the text whole: at most 36 characters, all of them from @ to _; never null."""
    return F.coalesce((F.translate(text, _LETTERS, "") == "") & (F.length(text) <= LETTER_CHARS * LETTER_WORDS), F.lit(False))


def packed_letters(text: Column) -> list[Column]:
    """The characters as five bits each of LETTER_WORDS long numbers, never null; only for texts with fits_letters()."""
    part = lambda k: F.translate(F.substring(text, LETTER_CHARS * k + 1, LETTER_CHARS), _LETTERS, _DIGITS)
    return [F.coalesce(F.conv(part(k), 32, 10).cast("long"), F.lit(0)) for k in range(LETTER_WORDS)]


def _added(parts: list[Column]) -> Column:
    out = parts[0]
    for x in parts[1:]:
        out = out + x
    return out


def packed_popcount(a: list[Column], b: list[Column]) -> Column:
    """popcount_hamming of two packed texts of one length."""
    return _added([F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b)])


def _differing(x: Column, y: Column) -> Column:
    """The high bit of each byte that differs."""
    return (x.bitwiseXOR(y) + F.lit(_LOW)).bitwiseAND(F.lit(_HIGH))


def packed_symbols(a: list[Column], b: list[Column]) -> Column:
    """symbol_hamming of two packed texts of one length."""
    return _added([F.bit_count(_differing(x, y)) for x, y in zip(a, b)])


def packed_places(a: list[Column], b: list[Column]) -> Column:
    """The sum of the places (from 1) at which two packed texts of one length differ."""
    of_bit = [sum(0x80 << 8 * (PACK_CHARS - k) for k in range(1, PACK_CHARS + 1) if k >> bit & 1) for bit in range(3)]
    parts = []
    for k, (x, y) in enumerate(zip(a, b)):
        d = _differing(x, y)
        parts += [F.bit_count(d) * F.lit(PACK_CHARS * k)] * (k > 0) + [F.bit_count(d.bitwiseAND(F.lit(m))) * F.lit(1 << bit) for bit, m in enumerate(of_bit)]
    return _added(parts)


def clean_regions(text: Column, mark: str = "*") -> Column:
    """The regions of a marked sequence, without gaps."""
    return F.split(F.translate(text, "-", ""), "\\" + mark)


def region_lengths(regions: Column) -> Column:
    return F.transform(regions, lambda r: F.length(r))


def region_intervals(lengths: Column, front: Column | None = None) -> Column:
    """Half-open [s, e) intervals of consecutive regions, after ``front`` residues."""
    shift = F.lit(0) if front is None else front
    zero = F.array().cast("array<struct<s:int,e:int>>")

    def step(acc: Column, n: Column) -> Column:
        s = F.when(F.size(acc) > 0, F.element_at(acc, -1)["e"]).otherwise(shift).cast("int")
        return F.concat(acc, F.array(F.struct(s.alias("s"), (s + n).cast("int").alias("e"))))

    return F.aggregate(lengths, zero, step)


def region_vector(length: Column, intervals: Column) -> Column:
    """For each position the number of its region (1-based), 0 outside."""
    return F.transform(F.sequence(F.lit(0), length - 1), lambda i: F.aggregate(F.transform(intervals, lambda r, k: F.when((i >= r["s"]) & (i < r["e"]), k + 1).otherwise(0)), F.lit(0), lambda acc, x: F.greatest(acc, x)))


def sliding_windows(text: Column, size: int = 150, step: int = 100, above: int = 200) -> Column:
    """Windows of a long text from every multiple of step; a text of at most ``above`` characters is one window."""
    starts = F.sequence(F.lit(0), F.length(text) - 1, F.lit(step))
    cut = F.transform(starts, lambda i: F.struct(i.cast("int").alias("start"), F.substring(text, i + 1, F.lit(size)).alias("window")))
    return F.when(F.length(text) > above, cut).when(F.length(text) > 0, F.array(F.struct(F.lit(0).alias("start"), text.alias("window"))))


def gene_prefix(gene: Column, mark: str) -> Column:
    """The gene before its mark; without the mark the last character is cut."""
    at = F.instr(gene, mark)
    return F.when(at > 0, F.substring(gene, F.lit(1), at - 1)).otherwise(F.substring(gene, F.lit(1), F.greatest(F.length(gene) - 1, F.lit(0))))


def similar_gene(a: Column, b: Column, mark: str) -> Column:
    return (a == b) | (gene_prefix(a, mark) == gene_prefix(b, mark))


def clonotype_fields(clonotype: Column) -> Column:
    """struct(v, j, cdr3) of ``V|..;J|..;CDR3``."""
    part = F.split(clonotype, ";")
    first = lambda c: F.element_at(F.split(c, "\\|"), 1)
    return F.struct(first(F.get(part, F.lit(0))).alias("v"), first(F.get(part, F.lit(1))).alias("j"), F.get(part, F.lit(2)).alias("cdr3"))


def residue_codes(text: Column, order: str = RESIDUES) -> Column:
    """Codes of residues in either case; unknown symbols count as X."""
    folded = F.translate(F.upper(text), "".join(RESIDUE_ALIASES), "".join(RESIDUE_ALIASES.values()))
    unknown = order.index("X")
    return F.transform(chars(folded), lambda c: F.when(F.instr(F.lit(order), c) > 0, F.instr(F.lit(order), c) - 1).otherwise(unknown))


def residue_text(codes: Column, order: str = RESIDUES) -> Column:
    return F.array_join(F.transform(codes, lambda i: F.substring(F.lit(order), i + 1, F.lit(1))), "")


def recode(codes: Column, source: str = RESIDUES, target: str = INTERNAL_ORDER) -> Column:
    """Codes in one residue order as codes in the other."""
    table = F.array(*[F.lit(target.index(c)) for c in source])
    return F.transform(codes, lambda i: F.get(table, i))


def one_hot(codes: Column, n: int) -> Column:
    return F.transform(codes, lambda i: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: (k == i).cast("int")))


def deletion_value(deletions: Column) -> Column:
    return F.transform(deletions, lambda d: F.atan(d / 3.0) * (2.0 / 3.141592653589793))


def has_deletion(deletions: Column) -> Column:
    return F.transform(deletions, lambda d: F.least(F.greatest(d, F.lit(0)), F.lit(1)))


def identity_score(a: Column, b: Column, inserts: Column | None = None) -> Column:
    """(matches - mismatches - inserts) / length of equally long texts."""
    score = _total(F.zip_with(chars(a), chars(b), lambda x, y: F.when(x == y, 1).otherwise(-1)), lambda x: x)
    return F.when(F.length(a) == F.length(b), (score - (F.lit(0) if inserts is None else inserts)) / F.length(a))


def letter_block(text: Column) -> Column:
    """struct(start, end) of the first run that begins and ends in a capital letter with letters and gaps between."""
    run = F.regexp_extract(text, "([A-Z](?:[A-Z-]*[A-Z])?)", 1)
    at = F.instr(text, run)
    return F.when(F.length(run) > 0, F.struct((at - 1).cast("int").alias("start"), (at - 1 + F.length(run)).cast("int").alias("end")))


def spreadsheet_id(number: Column) -> Column:
    """1 is A, 27 is AA, 28 is BA: least significant letter first, as many as a 64-bit number needs."""
    zero = F.struct(F.lit("").alias("text"), number.cast("long").alias("rest"))

    def step(acc: Column, _: Column) -> Column:
        more = acc["rest"] > 0
        letter = F.char(((acc["rest"] - 1) % 26 + 65).cast("int"))
        return F.struct(F.when(more, F.concat(acc["text"], letter)).otherwise(acc["text"]).alias("text"), F.when(more, F.floor((acc["rest"] - 1) / 26)).otherwise(F.lit(0).cast("long")).alias("rest"))

    return F.when(number.isNotNull(), F.aggregate(F.sequence(F.lit(1), F.lit(14)), zero, step)["text"])


# Fixed value: the form of an identifier that ends in a species code.
SPECIES_FORM = r"^(?:tr|sp)\|[A-Za-z0-9]{6,10}(?:_\d)?\|[A-Za-z0-9]+_([A-Za-z0-9]{1,12})(?:_\d+)?$"
# Characters that don't stand in a path.
NO_PATH_CHARS = '<:"/\\|?*+-()[]{}'


def species_id(description: Column) -> Column:
    """The species code of the first word of a description (before a slash), '' where there is none."""
    word = F.regexp_extract(description, r"^\s*([^\s/]*)", 1)
    return F.coalesce(F.regexp_extract(word, SPECIES_FORM, 1), F.lit(""))


def safe_name(name: Column) -> Column:
    """A name fit for a path: special characters removed, blanks, commas and line ends as underscores."""
    return F.translate(F.translate(name, NO_PATH_CHARS, ""), " ,\r\n", "____")


def gap_count(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, "-", ""))


def largest_share(text: Column) -> Column:
    """Share of the most frequent symbol."""
    c = chars(text)
    most = F.aggregate(F.array_distinct(c), F.lit(0), lambda acc, x: F.greatest(acc, F.size(F.filter(c, lambda y: y == x))))
    return F.when(F.length(text) > 0, most / F.length(text))


def substitution_table(text: str) -> dict[str, dict[str, int]]:
    """A substitution matrix in the usual text form (header of residues, one row each)."""
    lines = [x.split() for x in text.strip().splitlines() if x.strip() and not x.startswith("#")]
    return {row[0]: dict(zip(lines[0], map(int, row[1:]))) for row in lines[1:]}


def substitution_score(a: Column, b: Column, table: dict[str, dict[str, int]], weights: Column | None = None, frozen: Sequence[int] = (), strict_gap: Sequence[int] = ()) -> Column:
    """Per-position scores; frozen positions score at most 0 on a mismatch, strict ones -50 on a gap in b."""
    literal = F.create_map(*[x for p, row in table.items() for q, v in row.items() for x in (F.lit(p + q), F.lit(v))])
    pair = F.zip_with(chars(a), chars(b), lambda x, y: F.concat(x, y))
    score = F.transform(pair, lambda p: F.element_at(literal, p).cast("double"))
    if weights is not None:
        score = F.zip_with(score, weights, lambda s, w: s * w)
    if frozen:
        at = F.array(*[F.lit(i) for i in frozen])
        score = F.transform(score, lambda s, i: F.when(F.array_contains(at, i) & (F.substring(a, i + 1, F.lit(1)) != F.substring(b, i + 1, F.lit(1))), F.least(s, F.lit(0.0))).otherwise(s))
    if strict_gap:
        at = F.array(*[F.lit(i) for i in strict_gap])
        score = F.transform(score, lambda s, i: F.when(F.array_contains(at, i) & (F.substring(b, i + 1, F.lit(1)) == "-"), F.lit(-50.0)).otherwise(s))
    return score


def contiguous_bucket(row: Column, n: Column, k: Column) -> Column:
    """Bucket of row (0-based) if bucket i holds rows floor(i n / k) up to floor((i + 1) n / k)."""
    return F.floor(((row + 1) * k - 1) / n).cast("int")
