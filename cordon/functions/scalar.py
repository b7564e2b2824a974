"""Column functions: text, ids, vectors, ranks, percentiles and rounding. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a `Key: value` line of a document's metadata.
METADATA = r"^([A-Za-z][A-Za-z0-9 /]{0,40}):\s+(\S.*)$"


def sentences(text: Column) -> Column:
    """Sentences, cut after . ! or ? and blanks; a text without any is its own single sentence."""
    trimmed = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    found = F.filter(F.split(trimmed, r"(?U)(?<=[.!?])\s+"), lambda s: s != "")
    return F.when(F.size(found) > 0, found).otherwise(F.array(trimmed))


def is_heading(line: Column) -> Column:
    """Not indented, with a letter, and unchanged by upper-casing."""
    return ~line.rlike(r"(?U)^\s") & (F.trim(line) != "") & (line == F.upper(line)) & line.rlike(r"\p{L}")


def is_table_row(line: Column) -> Column:
    return line.rlike(r"(?U)^\s+\S")


def metadata_pair(line: Column) -> Column:
    """struct(key, value), both without blanks at their ends, of a metadata line, else null."""
    pattern = f"(?sU){METADATA}"  # a line holds no line feed, but may hold other line ends
    key, value = (F.regexp_replace(F.regexp_extract(line, pattern, i), r"(?U)\s+$", "") for i in (1, 2))
    return F.when(line.rlike(pattern), F.struct(key.alias("key"), value.alias("value")))


def metadata_map(lines: Column) -> Column:
    """Metadata of an array of lines; the last of equal keys counts. Keeps the place of a key's first line."""
    pairs = F.filter(F.transform(lines, metadata_pair), lambda p: p.isNotNull())
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    last = lambda k: F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1)["value"]
    return F.map_from_arrays(keys, F.transform(keys, last))


def metadata_suffix(metadata: Column) -> Column:
    """`k: v` joined by ` | `, in source order."""
    return F.array_join(F.transform(F.map_entries(metadata), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), " | ")


def char_windows(text: Column, size: int = 512) -> Column:
    """Windows of `size` code points; an empty text has one empty window."""
    n = F.greatest(F.lit(0), F.floor((F.length(text) - 1) / size).cast("int"))
    return F.transform(F.sequence(F.lit(0), n), lambda i: F.substring(text, i * size + 1, F.lit(size)))


def with_path(content: Column, path: Column) -> Column:
    """The text that is embedded: the section path before the content, if there is one."""
    return F.when(F.coalesce(F.size(path), F.lit(0)) > 0, F.concat(F.array_join(path, " > "), F.lit("\n\n"), content)).otherwise(content)


def chunk_name(slug: Column, category: Column, stem: Column, index: Column) -> Column:
    """slug/category/stem#n, n from 1."""
    return F.concat(F.concat_ws("/", slug, category, stem), F.lit("#"), (index + 1).cast("string"))


def chunk_name_parts(name: Column) -> Column:
    """struct(path, slug, category, stem, ordinal) of a chunk's name."""
    path, parts = F.substring_index(name, "#", 1), F.split(F.substring_index(name, "#", 1), "/")
    at = lambda i: F.get(parts, F.lit(i))
    return F.struct(F.concat(path, F.lit(".txt")).alias("path"), at(0).alias("slug"), at(1).alias("category"), F.regexp_replace(at(2), r"\.txt$", "").alias("stem"), F.try_to_number(F.substring_index(name, "#", -1), F.lit("999999999")).cast("int").alias("ordinal"))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null if a vector is zero or null, or their lengths differ."""
    return F.when(F.size(a) == F.size(b), F.lit(1.0) - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))))


def random_vector(dim: int, seed: int, key: Column) -> Column:
    """A vector uniform in (-1, 1) that depends on key and seed alone, so that recomputation repeats it."""
    unit = lambda i: F.pmod(F.xxhash64(key, i, F.lit(seed)), F.lit(1 << 52)).cast("double") / float(1 << 52)
    return F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: (unit(i) * 2 - 1).cast("float"))


def chunk_id(document: Column, index: Column) -> Column:
    """A uuid-shaped id that recomputation repeats, unlike uuid()."""
    h = F.md5(F.concat_ws("#", document, index.cast("string")))
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def nearest_rank(values: Column, p: float) -> Column:
    """Element bround(p * (n - 1)) of a sorted array, from 0; null if it is empty."""
    n = F.size(values)
    at = F.greatest(F.lit(0), F.least(n - 1, F.bround(F.lit(p) * (n - 1)).cast("int")))
    return F.when(n > 0, F.get(values, at))


def floor_rank(values: Column, p: float) -> Column:
    """Element min(floor(n * p), n - 1) of a sorted array, from 0; null if it is empty."""
    n = F.size(values)
    return F.when(n > 0, F.get(values, F.least(n - 1, F.floor(F.lit(p) * n).cast("int"))))


def rank_score(frequencies: Column, terms: Column) -> Column:
    """The rank of a text for an OR query of so many distinct terms, from the frequencies of those it has.

    Each of a term's occurrences weighs 0.1 over the square of its number; the sum is taken over pi**2 / 6 and the terms.
    """
    series = lambda tf: F.aggregate(F.sequence(F.lit(1), tf), F.lit(0.0), lambda s, j: s + 1 / (j * j))
    return F.try_divide(F.aggregate(frequencies, F.lit(0.0), lambda s, tf: s + 0.1 * series(tf.cast("int")) / 1.64493406685), terms)


def claim_tenant(claims: Column) -> Column:
    """tenant_id of a JSON claim: null if the claim or the key is; text that isn't JSON (the empty text too) raises."""
    return F.variant_get(F.parse_json(claims), "$.tenant_id", "string")
