"""Document fingerprints: a Merkle tree over sections, paragraphs and their sentences. DataFrame operations only.

Sections end after an empty line, paragraphs at a line's end, sentences after ``.``, ``!`` or ``?`` within a paragraph; all
separators stay with the part before them, so the parts of a text put together are the text. A leaf is the SHA-256 of a
sentence, a node the SHA-256 of its children's hashes. Equal roots mean equal texts; where roots differ, the differing
children lead to what was edited.

The fingerprint is a string that holds the tree: the root's 64 hex digits; then a section each after ``|``, its paragraphs
between ``/`` and of each paragraph the leaves between ``,``; then, after ``#``, the inner nodes: a section each after ``|``, its
own hash and those of its paragraphs between ``/``. All but the root are cut to 12 hex digits. Likeness of two fingerprints is
the share of distinct leaves they have in common, of those of the longer one.

Null text is the empty text; two empty texts are alike. Very long texts are hashed whole. Rows with null doc_ids come first,
rows of one doc_id in the order of two hashes of their texts; equal rows follow each other. An empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

DIGITS = 12


def leaves(text: Column) -> Column:
    """Hashes as an array of sections of paragraphs of sentences."""

    def sentences(paragraph: Column) -> Column:
        return F.transform(F.split(paragraph, r"(?<=[.!?])(?=[^.!?\n])"), lambda s: F.sha2(s, 256))

    return F.transform(F.split(text, r"(?<=\n\n)(?=[^\n])"), lambda s: F.transform(F.split(s, r"(?<=\n)(?=[^\n])"), sentences))


def node(children: Column) -> Column:
    return F.sha2(F.array_join(children, ""), 256)


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), body), 0)


def _cut(x: Column) -> Column:
    return F.substring(x, 1, DIGITS)


def fingerprint(tree: Column) -> Column:
    def leaf_part(section: Column) -> Column:
        return F.array_join(F.transform(section, lambda p: F.array_join(F.transform(p, _cut), ",")), "/")

    def of(t: Column) -> Column:
        return _let(F.transform(t, lambda section: F.transform(section, node)), lambda paragraphs: with_sections(t, paragraphs))

    def with_sections(t: Column, paragraphs: Column) -> Column:
        return _let(F.transform(paragraphs, node), lambda sections: written(t, paragraphs, sections))

    def written(t: Column, paragraphs: Column, sections: Column) -> Column:
        inner = F.zip_with(sections, paragraphs, lambda s, p: F.concat(_cut(s), F.lit("/"), F.array_join(F.transform(p, _cut), "/")))
        return F.concat(node(sections), F.lit("|"), F.array_join(F.transform(t, leaf_part), "|"), F.lit("#"), F.array_join(inner, "|"))

    return _let(tree, of)


def _leaf_part(x: Column) -> Column:
    return F.substring_index(F.substring(x, 66, 1 << 30), "#", 1)


def likeness(one: Column, other: Column) -> Column:
    """0 to 1, from two fingerprints."""
    a, b = (F.array_distinct(F.split(_leaf_part(x), "[|/,]")) for x in (one, other))
    return _let(a, lambda x: _let(b, lambda y: F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.size(y))))


EDIT = "array<struct<section:int,paragraph:int,gone:int,added:int>>"


def edits(one: Column, other: Column) -> Column:
    """Of two fingerprints, where the first differs, as an array of (section, paragraph, gone, added): from that paragraph on, ``gone`` paragraphs of the first stand where the second has ``added``. Empty for equal roots.

    The tree is descended: equal nodes at the beginning and at the end of the sections are left out; if as many sections
    differ on both sides they are compared one by one, else as one stretch. In each, equal paragraphs at both ends are left
    out again. So the work is linear, and what is put in before equal paragraphs does not mark them.
    """

    def inner(x: Column) -> Column:
        return F.transform(F.split(F.substring_index(x, "#", -1), r"\|"), lambda s: F.split(s, "/"))

    def same_start(x: Column, y: Column) -> Column:
        first = F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), F.lit(False)).cast("int")
        return F.when(first > 0, first - 1).otherwise(F.size(x))

    def part(x: Column, start: Column, end: Column) -> Column:
        """Without ``start`` at the beginning and ``end`` at the end."""
        return F.slice(x, start + 1, F.size(x) - start - end)

    def narrowed(x: Column, y: Column, body) -> Column:
        """body(start, end, x, y): how much is equal at both ends, and what lies between."""
        return _let(same_start(x, y), lambda a: _let(same_start(F.reverse(part(x, a, F.lit(0))), F.reverse(part(y, a, F.lit(0)))), lambda b: body(a, b, part(x, a, b), part(y, a, b))))

    def stretch(section: Column, x: Column, y: Column) -> Column:
        """x, y: paragraphs of a section, or of several as one stretch."""
        found = narrowed(x, y, lambda a, _, p, q: F.struct(section.alias("section"), a.alias("paragraph"), F.size(p).alias("gone"), F.size(q).alias("added")))
        return found

    def paragraphs(section: Column) -> Column:
        return F.slice(section, 2, F.greatest(F.size(section) - 1, F.lit(0)))

    def compared(a: Column, x: Column, y: Column) -> Column:
        pairs = F.arrays_zip(x.alias("x"), y.alias("y"), F.sequence(F.lit(0), F.size(x) - 1).alias("i"))
        single = F.transform(F.filter(pairs, lambda z: F.get(z["x"], 0) != F.get(z["y"], 0)), lambda z: stretch(a + z["i"], paragraphs(z["x"]), paragraphs(z["y"])))
        joint = F.array(stretch(a, F.flatten(F.transform(x, paragraphs)), F.flatten(F.transform(y, paragraphs))))
        return F.when((F.size(x) == F.size(y)) & (F.size(x) > 0), single).otherwise(joint)

    def heads(sections: Column) -> Column:
        return F.transform(sections, lambda s: F.get(s, 0))

    def whole(x: Column, y: Column) -> Column:
        return narrowed(heads(x), heads(y), lambda a, b, _, __: compared(a, part(x, a, b), part(y, a, b)))

    found = _let(inner(one), lambda x: _let(inner(other), lambda y: whole(x, y)))
    return F.when(F.substring(one, 1, 64) == F.substring(other, 1, 64), F.array().cast(EDIT)).otherwise(found.cast(EDIT))


KEYS = ["doc_id", "t1", "t2"]


def boundaries(keyed: DataFrame, rows_each: int, most: int) -> DataFrame:
    """(doc_id, t1, t2): the first rows of buckets of about ``rows_each`` rows, or of more rows each, so that at most about ``most`` come to the driver. With ``most`` = 100,000 a bucket of 10^10 rows holds 100,000, a task of common size."""
    rows_each = max(rows_each, keyed.count() // most)
    ranged = keyed.select(*KEYS).repartitionByRange(*KEYS).sortWithinPartitions(*KEYS).select(*KEYS, F.monotonically_increasing_id().alias("place"))
    # Places count from 0 in each partition, in the lower 33 bits.
    return ranged.filter((F.col("place").bitwiseAND((1 << 33) - 1) % rows_each) == 0).select(*KEYS).distinct()


def with_next(docs: DataFrame, rows_each: int = 2048, most: int = 100_000) -> DataFrame:
    """(doc_id, text, fingerprint, next_text, next_fingerprint) in ascending doc_id order, ties by the texts' hashes; after the last comes the first. Null doc_ids come first.

    Texts are shuffled once. Rows go to buckets of consecutive (doc_id, text hashes), so a doc_id of many texts has many; each
    bucket's first row also goes to the bucket before it, behind that bucket's own rows, so that each row finds its next one in
    its bucket."""
    t1, t2 = shared.text_keys()
    keyed = docs.select("doc_id", t1.alias("t1"), t2.alias("t2"), shared.text_of().alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = boundaries(keyed, rows_each, most).orderBy(F.asc_nulls_first("doc_id"), "t1", "t2").select(F.to_json(F.struct(*KEYS)).alias("j")).collect()
    starts = [r["j"] for r in found]
    group = max(1, int(len(starts) ** 0.5))
    struct = f"struct<doc_id:{kind},t1:bigint,t2:bigint>"
    # Literals, folded once: the first of each group, and all by group.
    coarse = F.from_json(F.lit("[" + ",".join(starts[::group]) + "]"), f"array<{struct}>")
    fine = F.from_json(F.lit("[" + ",".join("[" + ",".join(starts[i : i + group]) + "]" for i in range(0, len(starts), group)) + "]"), f"array<array<{struct}>>")
    key = F.struct(*KEYS)
    rows = keyed.withColumn("fingerprint", fingerprint(leaves(F.col("text"))))
    rows = rows.withColumn("above", F.size(F.filter(coarse, lambda x: x <= key)))
    own_group = F.get(fine, F.col("above") - 1)
    rows = rows.withColumn("bucket", (F.col("above") - 1) * group + F.size(F.filter(own_group, lambda x: x <= key)) - 1)
    opens = F.get(own_group, F.col("bucket") % group).eqNullSafe(key)
    before = F.when(F.col("bucket") == 0, len(starts) - 1).otherwise(F.col("bucket") - 1)
    own, lent = F.struct(F.col("bucket").alias("at"), F.lit(False).alias("lent")), F.struct(before.alias("at"), F.lit(True).alias("lent"))
    dealt = rows.select(*KEYS, "text", "fingerprint", F.explode(F.when(opens, F.array(own, lent)).otherwise(F.array(own))).alias("to")).select(*KEYS, "text", "fingerprint", "to.at", "to.lent")
    order = Window.partitionBy("at").orderBy("lent", F.col("doc_id").asc_nulls_first(), "t1", "t2")
    return dealt.select("*", F.lead("text").over(order).alias("next_text"), F.lead("fingerprint").over(order).alias("next_fingerprint")).filter("not lent").select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint")


def with_edits(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, edits (from the text to the edited one)."""
    rows = with_next(docs)
    n = F.length("text").cast("long")
    edited = F.concat(F.expr("substring(text, 1, cast(length(text) - floor(length(text) / 2) as int))"), F.expr("substring(next_text, 1, cast(floor(length(text) / 2) as int))"))
    made = rows.select("doc_id", n.alias("n_chars"), edited.alias("edited"), "fingerprint", "next_fingerprint")
    prints = made.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", fingerprint(leaves(F.col("edited"))).alias("edited_fingerprint"), "next_fingerprint")
    return prints.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"), edits(F.col("fingerprint"), F.col("edited_fingerprint")).alias("edits"))
