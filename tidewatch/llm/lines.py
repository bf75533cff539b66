"""Line dedup: an edit-distance join of lines by their segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import connected_components, materialize, size_within, table

EDITS = 2  # edits by which near lines may differ
SHORTEST = 20  # characters; of shorter lines only equal ones are repeats
COUNTED = "etaoinshrdlcugwbfpzmvy.,"  # characters of the parity
HOT = 64  # pairs of a key from which on its lines are compared in blocks
BLOCK = 48  # lines of a block, about
SENT = 1_000_000  # ids of candidate lines that may travel to every task (8 bytes each); more are joined by a shuffle

HELD, ALIKE, LONGER = 3, 2, 1  # what a line is to a key: its own segment; a probe by a line as long; by a longer line


def probes(edits: int = EDITS) -> list[tuple[int, int, int, int]]:
    """(side, segment, how much shorter, shift) of the substrings of a line that can equal a segment of a line as long or
    shorter.

    If a line has no more edits than the threshold, some segment stands whole at a shift that both the edits before it
    and the edits behind it allow; only these shifts are probed. Those without shift or difference are also the line's
    own segments, so one key says both.
    """
    out = []
    for less in range(edits + 1):
        for i in range(edits + 1):
            for shift in range(-edits, edits + 1):
                if abs(shift) <= i and abs(shift - less) <= edits - i:
                    out.append((LONGER if less else ALIKE if shift else HELD, i, less, shift))
    return sorted(out, key=lambda x: -x[0])


def keys(lines: DataFrame, edits: int = EDITS) -> DataFrame:
    """id, key, side of lines (id, line, length): a row for each of probes(), whose key is a hash of the segment's number,
    the length of the line that has it and the characters. Of the edits + 1 segments of a line the last ones are longer by
    one. Lines must have 2 * edits + 1 characters at least, so that every probe lies inside.

    The probes are rows before they are hashed: an array of all their hashes is too much code for one compiled method.
    """
    table = [F.struct(F.lit(side).cast("byte").alias("side"), F.lit(i).alias("i"), F.lit(less).alias("less"), F.lit(shift).alias("shift")) for side, i, less, shift in probes(edits)]
    each = lines.select("id", "line", "length", F.inline(F.array(*table)))
    base = f"cast((length - less) div {edits + 1} as int)"
    late = f"i - {edits + 1} + (length - less) % {edits + 1}"  # from 0 on: how many longer segments stand before it
    part = F.expr(f"substring(line, 1 + shift + i * {base} + greatest(0, {late}), {base} + if({late} >= 0, 1, 0))")
    return each.select("id", F.xxhash64("i", F.expr("length - less"), part).alias("key"), "side")


def within(x: str = "x", y: str = "y", edits: int = EDITS) -> Column:
    return F.expr(within_sql(x, y, edits))


def within_sql(x: str = "x", y: str = "y", edits: int = EDITS) -> str:
    """Whether two arrays of characters differ by at most so many edits: a banded, bit-parallel automaton.

    Bit i of word r_e: the first j characters of x match the first j - edits + i of y with e edits. The words move along
    the diagonal, so a match and a substitution keep a bit's place, an insertion moves it down and a deletion up; the
    band of 2 * edits + 1 bits is all that can matter. Each step of the fold is one character of x. The last word holds the
    bits of the others; once it is empty nothing can come any more, and the rest of x is passed over.
    """
    mask = (1 << (2 * edits + 1)) - 1
    start = ", ".join(f"{((1 << (e + 1)) - 1) << edits & mask} as r{e}" for e in range(edits + 1))
    match = " + ".join(f"if(get({y}, j - {edits} + {i}) <=> {x}[j], {1 << i}, 0)" for i in range(2 * edits + 1))
    new = ["(a.r0 & m)"]
    for e in range(1, edits + 1):
        new.append(f"((a.r{e} & m | a.r{e - 1} | shiftright(a.r{e - 1}, 1) | shiftleft({new[-1]}, 1)) & {mask})")
    step = f"transform(array({match}), m -> named_struct({', '.join(f"'r{e}', {own}" for e, own in enumerate(new))}))[0]"
    folded = f"aggregate(sequence(0, size({x}) - 1), struct({start}), (a, j) -> if(a.r{edits} = 0, a, {step}), a -> a.r{edits})"
    near = f"abs(size({x}) - size({y})) <= {edits}"
    return f"case when not {near} then false when size({x}) = 0 or size({y}) = 0 then {near} else shiftright({folded}, size({y}) - size({x}) + {edits}) & 1 = 1 end"


def _hashes(line: str = "line") -> list[Column]:
    return [F.xxhash64(line).alias("hash"), F.xxhash64(F.lit(1), line).alias("other")]


def distinct_lines(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """id, line, length, hash, other: each different line that is long enough, once. Repeats are combined before the
    shuffle, so a line that very many documents have is a few rows."""
    own = docs.select(F.explode(F.split("text", "\n")).alias("line")).where(F.length("line") >= shortest).distinct()
    return materialize(own.select(F.monotonically_increasing_id().alias("id"), "line", F.length("line").alias("length"), *_hashes()), "lines")


def parity(line: Column) -> Column:
    """A bit for each of some characters: whether a line has an odd number of them. An edit changes two bits at most."""
    out = F.lit(0).cast("long")
    for i, c in enumerate(COUNTED):
        odd = (F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c), F.lit("")))).bitwiseAND(1)
        out = out.bitwiseOR(F.shiftleft(odd.cast("long"), i))
    return out


def near_lines(lines: DataFrame, edits: int = EDITS) -> tuple[DataFrame, DataFrame]:
    """Links (src, dst) that connect all different lines within so many edits of each other, and (id, degree): to how many
    lines each is near.

    lines: id, line, length; each line once. Segments and probes of a key come from one pass and one shuffle. Most keys
    belong to one line and go at once. Keys with few pairs are joined. Where a key would make many pairs its lines are
    compared in blocks, so that no row is made for a pair (_in_blocks).
    """
    dealt = keys(lines, edits).repartition("key")
    live = dealt.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.max("side").alias("top")).where(f"low <> high and top = {HELD}")
    met = materialize(dealt.join(live.select("key").hint("shuffle_hash"), "key").groupBy("key", "id").agg(F.max("side").alias("side")), "met")
    sizes = met.groupBy("key").agg(F.count("*").alias("n"), F.count_if(F.col("side") == HELD).alias("held"))
    sizes = materialize(sizes.where("held > 0 and n > 1"), "sizes")
    few = met.join(sizes.where(F.col("n") * F.col("held") <= HOT).select("key"), "key")
    pairs = few.alias("i").join(few.alias("p"), F.expr(f"i.key = p.key and i.side = {HELD} and i.id <> p.id and (p.side = {LONGER} or i.id < p.id)"))
    pairs = materialize(pairs.select(F.col("i.id").alias("src"), F.col("p.id").alias("dst")).distinct(), "pairs")
    many = sizes.where(F.col("n") * F.col("held") > HOT)
    hot = None
    if not many.isEmpty():
        hot = materialize(met.join(many.select("key", "n"), "key"), "hot")
        own = hot.groupBy("id").agg(F.collect_set(F.when(F.col("side") == HELD, F.col("key"))).alias("held"), F.collect_set("key").alias("asks"))
        own = materialize(own.join(lines.select("id", "line"), "id").select("id", "held", "asks", parity(F.col("line")).alias("odd"), F.split("line", "").alias("chars")), "members")
    wanted = pairs.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    texts = lines.join(F.broadcast(wanted) if size_within(wanted, SENT) else wanted, "id", "left_semi")
    texts = materialize(texts.select("id", "line", parity(F.col("line")).alias("odd")), "texts")
    odd = texts.select("id", "odd")
    if hot is not None:  # a pair that some block sees is left to it
        odd = odd.join(own.select("id", "held", "asks"), "id", "left")
    pairs = pairs.join(odd.withColumnsRenamed({"id": "src", "odd": "a", "held": "x"}).drop("asks"), "src").join(odd.withColumnsRenamed({"id": "dst", "odd": "b", "asks": "y"}).drop("held"), "dst")
    pairs = pairs.where(f"bit_count(a ^ b) <= {2 * edits}")
    if hot is not None:
        pairs = pairs.where("not coalesce(arrays_overlap(x, y), false)")
    split = texts.select("id", F.split("line", "").alias("chars"))
    both = pairs.select("src", "dst").join(split.withColumnsRenamed({"id": "src", "chars": "x"}), "src").join(split.withColumnsRenamed({"id": "dst", "chars": "y"}), "dst")
    links = materialize(both.where(within(edits=edits)).select("src", "dst"), "near")
    degree = links.select(F.explode(F.array("src", "dst")).alias("id"), F.lit(1).cast("long").alias("k"))
    if hot is not None:
        found = materialize(_in_blocks(hot, own, many, edits), "found")
        links = links.unionByName(found.where("src <> dst").select("src", "dst"))
        degree = degree.unionByName(found.select(F.col("src").alias("id"), F.col("k").cast("long").alias("k")))
    return links, degree.groupBy("id").agg(F.sum("k").alias("degree"))


def _in_blocks(hot: DataFrame, own: DataFrame, many: DataFrame, edits: int) -> DataFrame:
    """src, dst, k: for the lines of each two blocks of a key, a line that stands for those it is connected with there,
    and to how many lines it is near.

    The lines of a key are dealt to blocks of bounded size by hash, and each two blocks meet in one row, which belongs to
    the key and both blocks: even a key of very many lines is spread over all tasks. A pair counts in the first key only
    in which both lines meet. Parities are compared before the automaton runs.
    """
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    member = F.struct("id", "side", "odd", "held", "asks", "chars")
    blocks = hot.withColumn("part", F.pmod(F.xxhash64("id", "key"), parts).cast("int")).join(own, "id").groupBy("key", "part").agg(F.collect_list(member).alias("lines"))
    blocks = materialize(blocks, "blocks")
    two = many.select("key", parts.alias("parts")).select("key", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("lo")).select("key", "lo", F.explode(F.sequence("lo", F.col("parts") - 1)).alias("hi"))
    both = two.join(blocks.withColumnsRenamed({"part": "lo", "lines": "first"}), ["key", "lo"]).join(blocks.withColumnsRenamed({"part": "hi", "lines": "second"}), ["key", "hi"])
    both = both.select("key", F.size("first").alias("cut"), (F.col("lo") < F.col("hi")).alias("across"), F.expr("if(lo < hi, concat(first, second), first)").alias("m"))
    one_way = "{0}.side = %d and ({1}.side = %d or {0}.id < {1}.id) and array_min(array_intersect({0}.held, {1}.asks)) = key" % (HELD, LONGER)
    chars = f"transform(array(named_struct('x', m[p].chars, 'y', m[q].chars)), z -> {within_sql('z.x', 'z.y', edits)})[0]"
    near = f"""transform(sequence(0, size(m) - 1), q -> filter(sequence(0, size(m) - 1), p -> p < q and (not across or p < cut and q >= cut)
        and bit_count(m[p].odd ^ m[q].odd) <= {2 * edits} and ({one_way.format("m[p]", "m[q]")} or {one_way.format("m[q]", "m[p]")}) and {chars}))"""
    both = both.select(F.expr("transform(m, z -> z.id)").alias("ids"), F.expr(near).alias("near")).where("exists(near, z -> size(z) > 0)")
    # of connected lines the first stands for all: each line joins the labels of those before it that it is near to
    label = """aggregate(sequence(0, size(ids) - 1), sequence(0, size(ids) - 1), (lab, q) -> if(size(near[q]) = 0, lab,
        transform(array(array_append(transform(near[q], p -> lab[p]), lab[q])), own -> transform(lab, l -> if(array_contains(own, l), array_min(own), l)))[0]))"""
    both = both.select("ids", F.expr(label).alias("label"), F.expr("transform(near, z -> size(z))").alias("before"), F.flatten("near").alias("after"))
    count = "before[i] + size(filter(after, p -> p = i))"
    rows = F.expr(f"filter(transform(sequence(0, size(ids) - 1), i -> named_struct('src', ids[i], 'dst', ids[label[i]], 'k', {count})), z -> z.k > 0)")
    return both.select(F.explode(rows).alias("z")).select("z.*")


def dedup(docs: DataFrame, edits: int = EDITS, shortest: int = SHORTEST) -> DataFrame:
    """docs with text without its repeated lines, and n_lines, n_dropped, n_links (long).

    Lines are what newlines part, taken as they are. Two lines are near if they differ by at most `edits` insertions,
    deletions or substitutions of characters (those beyond the basic plane count as two). Near and equal lines, and what
    they reach over others, form classes; of a class the first line stays, by doc_id, then place, and all others go.
    Lines shorter than `shortest` characters are near to none, so their classes are equal lines; of these, lines of white
    space and empty ones always stay. n_links counts the different lines near to
    those of a document. A null text stays null and has no lines; an empty one has a single empty line. Rows equal in
    doc_id and text count as one document. Null doc_ids come first. Other columns are kept, but for three of these names.
    """
    if shortest < 2 * edits + 1:
        raise ValueError("lines must be longer than twice the edits")
    own = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), F.posexplode(F.split("text", "\n")).alias("n", "line"))
    own = own.where((F.length("line") >= shortest) | F.col("line").rlike(r"\S"))
    places = materialize(own.select("doc_id", "row", "n", *_hashes()), "places")
    lines = distinct_lines(docs, shortest)
    links, degree = near_lines(lines.select("id", "line", "length"), edits)
    linked = connected_components(links).join(degree, "id").join(lines.select("id", "hash", "other"), "id")
    linked = materialize(linked.select("hash", "other", F.col("component").alias("class"), "degree"), "linked")
    placed = places.join(linked, ["hash", "other"], "left")
    # a class is that of near lines, or else all lines of the same two hashes
    placed = placed.select("doc_id", "row", "n", F.coalesce("class", "hash").alias("class"), F.when(F.col("class").isNull(), F.col("other")).alias("rest"))
    firsts = placed.groupBy("class", "rest").agg(F.min(F.struct("doc_id", "row", "n")).alias("first"), F.count("*").alias("often")).where("often > 1")
    gone = placed.join(firsts.select(F.col("class").alias("own"), F.col("rest").alias("other"), "first"), F.expr("class = own and rest <=> other and struct(doc_id, row, n) <> first"))
    near = places.join(linked, ["hash", "other"]).select("doc_id", "row", "hash", "other", "degree").distinct()
    marks = gone.select("doc_id", "row", "n", F.lit(0).cast("long").alias("degree")).unionByName(near.select("doc_id", "row", F.lit(None).cast("int").alias("n"), "degree"))
    marked = marks.groupBy("doc_id", "row").agg(F.collect_set("n").alias("gone"), F.sum("degree").alias("degree"))
    # the columns of docs go as one, so that none can clash
    held = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), F.struct(*docs.columns).alias("doc")).alias("d")
    out = held.join(marked.hint("shuffle_hash").alias("m"), F.expr("d.doc_id <=> m.doc_id and d.row = m.row"), "left").select("doc", "gone", "degree")
    text = F.split("doc.text", "\n")
    kept = F.when(F.col("gone").isNull(), F.col("doc.text")).otherwise(F.array_join(F.filter(text, lambda x, i: ~F.array_contains("gone", i)), "\n"))
    names = {"n_lines", "n_dropped", "n_links"}
    return out.select(
        *[kept.alias("text") if c == "text" else F.col("doc").getField(c).alias(c) for c in docs.columns if c not in names],
        F.coalesce(F.size(text), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce("degree", F.lit(0)).cast("long").alias("n_links"),
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", "n_links", F.length("text").cast("long").alias("chars_kept"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
