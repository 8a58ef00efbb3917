"""Defect lists: text to rows, image pages, layer names, byte spans."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.ordered import next_value, running_total
from gridloom.operators.overlap import bbox_join


def sequential_pages(images: DataFrame) -> DataFrame:
    """(image_id, page): pages dealt out in file order; none for images without."""
    placed = running_total(images, "rec_no", F.col("n_pages"), "first_page").where("n_pages > 0")
    return placed.select("image_id", F.explode(F.sequence(F.col("first_page"), F.col("first_page") + F.col("n_pages") - 1)).alias("page"))


def row_ids(rows: DataFrame, order: str) -> DataFrame:
    """1-based numbers in file order, for lists without ids."""
    return running_total(rows, order, F.lit(1), "_n").withColumn("row_id", F.col("_n") + 1).drop("_n")


def byte_spans(index: DataFrame, file_size: Column | int) -> DataFrame:
    """Bytes to the next offset, or to the end of the file for the last."""
    span = F.coalesce("_next", F.lit(file_size)) - F.col("byte_offset")
    return next_value(index, "byte_offset", "_next").withColumn("byte_span", span).drop("_next")


def giant_cells(spans: DataFrame, least: int, top: int) -> DataFrame:
    """The largest spans, of a least size."""
    return spans.where(F.col("byte_span") >= least).orderBy(F.desc("byte_span"), "cell_id").limit(top)


#: Numbers of layers and datatypes have so many bits.
_LEVELS = 31


def _blocks_of(low: Column, high: Column) -> Column:
    """The interval as few blocks (level, number) of 2**level numbers each."""
    start = F.struct(low.cast("long").alias("l"), (high.cast("long") + 1).alias("r"), F.array().cast("array<struct<level:int,block:bigint>>").alias("out"))

    def climb(acc: Column, k: Column) -> Column:
        block = lambda n: F.array(F.struct(k.alias("level"), n.alias("block")))
        none = F.array().cast("array<struct<level:int,block:bigint>>")
        open_ = acc["l"] < acc["r"]
        left = F.when(open_ & (acc["l"] % 2 == 1), block(acc["l"])).otherwise(none)
        right = F.when(open_ & (acc["r"] % 2 == 1), block(acc["r"] - 1)).otherwise(none)
        return F.struct(F.shiftright(acc["l"] + 1, 1).alias("l"), F.shiftright(acc["r"], 1).alias("r"), F.concat(acc["out"], left, right).alias("out"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(_LEVELS)), start, climb, lambda acc: acc["out"])


def layer_name(layers: DataFrame, names: DataFrame) -> DataFrame:
    """(layer, datatype, name): the narrowest interval that holds the key.

    By width of the layer interval, then of the datatype interval, then file
    order; an open interval of all layers names nothing; no match gives ''.
    Intervals are cut into blocks of powers of two, of which a layer lies in one
    for each power, so names and keys meet by equality.
    """
    wide = F.lit(2**31 - 1)
    keys = layers.select("layer", "datatype").distinct()
    usable = names.where(~((F.col("l_lo") == 0) & F.col("l_hi").isNull()))
    cut = usable.withColumn("_b", F.explode(_blocks_of(F.greatest("l_lo", F.lit(0)), F.coalesce("l_hi", wide)))).select("*", "_b.level", "_b.block")
    spread = keys.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(_LEVELS)))).withColumn("block", F.expr("shiftright(cast(layer as bigint), level)"))
    held = (F.col("datatype") >= F.col("d_lo")) & (F.col("datatype") <= F.coalesce("d_hi", wide))
    rank = F.struct((F.coalesce("l_hi", wide) - F.col("l_lo")).alias("lw"), (F.coalesce("d_hi", wide) - F.col("d_lo")).alias("dw"), "rec_no")
    best = cut.join(spread, ["level", "block"]).where(held).groupBy("layer", "datatype").agg(F.min_by("name", rank).alias("name"))
    return keys.join(best, ["layer", "datatype"], "left").na.fill("", ["name"])


#: Patterns of the defect list format.
_PITCH_NEW, _PITCH_OLD = r"DiePitch\s*[0-9]*\s*\{\s*([-+0-9.eE]+)\s*,?\s*([-+0-9.eE]+)", r"DiePitch\s+([-+0-9.eE]+)\s+([-+0-9.eE]+)"
#: Tokens: an image list with its braces, a quoted text, a mark, the end of a line, or anything else up to one of these.
_TOKEN = re.compile(r"""(?P<images>Images?\s+[0-9]+\s*\{(?:"[^"]*+"|[^"}]++)*+\})|"[^"]*"|[{};\n]|[^\s{};"]+""")
#: Rows that are handed to Spark at once.
_ROWS_AT_ONCE = 5000


class _Tokens:
    """The tokens of a text, one ahead; line ends only where they are asked for."""

    def __init__(self, text: str):
        self._found = _TOKEN.finditer(text)
        self.now: str | None = ""
        self.step()

    def step(self) -> str | None:
        before = self.now
        m = next(self._found, None)
        self.now, self.images = (m[0], m["images"] is not None) if m else (None, False)
        return before

    def seek(self, *wanted: str) -> str | None:
        """Past the next of the wanted tokens; which one it was."""
        while self.now is not None and self.now not in wanted:
            self.step()
        return self.step()

    def until(self, *ends: str) -> list[str]:
        out = []
        while self.now is not None and self.now not in ends:
            out.append(self.step())
        self.step()
        return out


def _closed_rows(tokens: _Tokens, end: str, most: int | None) -> Iterator[list[tuple[str, bool]]]:
    """Rows that end with a semicolon, over any number of lines."""
    row: list[tuple[str, bool]] = []
    done = 0
    while tokens.now not in (None, end) and (most is None or done < most):
        images, token = tokens.images, tokens.step()
        if token == ";":
            if row:
                yield row
                done += 1
            row = []
        elif token != "\n":
            row.append((token, images))
    if row and end == "EndOfList":  # the last one of a flat list may be left open
        yield row


def _counted_rows(tokens: _Tokens, columns: int) -> Iterator[list[tuple[str, bool]]]:
    """Rows that end with a line, but not before they have all their columns."""
    row: list[tuple[str, bool]] = []
    while tokens.now is not None:
        images, token = tokens.images, tokens.step()
        if token == "\n":
            if row and len(row) >= columns:
                yield row
                row = []
        elif token == ";":
            if row:
                yield row
                row = []
            while tokens.now == "\n":
                tokens.step()
            if tokens.now is None or tokens.now[0].isalpha():  # a semicolon and the next section
                return
        else:
            row.append((token, images))
    if row:
        yield row


def _rows(text: str, nested: bool | None) -> Iterator[tuple[dict[str, str], str | None]]:
    """(values by column, image file) of the rows of a text's first list."""
    if nested is None:
        nested = re.match(r"\s*record\s+filerecord\b", text, re.I) is not None and re.search(r"\bColumns\s+[0-9]+\s*\{", text) is not None
    tokens = _Tokens(text)
    if nested:
        if tokens.seek("Columns") is None or tokens.seek("{") is None:
            return
        columns = [c.split()[-1] for c in " ".join(t for t in tokens.until("}") if t != "\n").split(",") if c.strip()]
        if tokens.seek("Data") is None:
            return
        count = tokens.step() or ""
        while tokens.now in ("\n", "{"):
            tokens.step()
        rows = _closed_rows(tokens, "}", int(count) if count.isdigit() else 0)
    else:
        columns: list[str] = []
        found = tokens.seek("DefectRecordSpec", "DefectList")
        if found == "DefectRecordSpec":
            columns = [c for c in tokens.until(";")[1:] if c != "\n"]
            found = tokens.seek("DefectList")
        if found is None:
            return
        named = tokens.until("\n")
        if named and named[0] != ";":  # the columns stand in the list's own line
            columns = named[1:]
            if tokens.now is not None and tokens.now.lower() == "data":
                tokens.until("\n")
            rows = _closed_rows(tokens, "EndOfList", None)
        else:
            rows = _counted_rows(tokens, len(columns))
    for row in rows:
        values, image, at = {}, None, 0
        for token, images in row:
            if images:
                image = image or next(iter(re.findall(r'"([^"]*)"', token)), None) or None
                if at >= len(columns) or "image" not in columns[at].lower():
                    values["_images"] = token
                    continue
            values[columns[at] if at < len(columns) else f"_extra_{at - len(columns) + 1}"] = token
            at += 1
        yield values, image


def defect_rows(files: DataFrame, nested: bool | None = None) -> DataFrame:
    """(path, rec_no, values, image_file): the rows of defect lists (path, content), as maps.

    One pass over a text cuts it into tokens; quoted texts and image lists in braces
    are one token each, whatever they hold. The nested form has ``Columns`` and ``Data``
    in braces; rows end with a semicolon. A flat list that names its columns in its own
    line ends rows the same way, up to ``EndOfList``; one that does not has them from
    ``DefectRecordSpec``, and a row goes on over lines until it has all of them. Without
    ``nested`` the first line decides, ``Record FileRecord`` in any case of letters; a
    text that begins so but has no columns in braces is read as flat. Only the first
    list of a text counts. Values stay texts; tokens past the columns are ``_extra_N``,
    image lists where no column is named for images ``_images``.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.schema([("path", pa.string()), ("rec_no", pa.int32()), ("values", pa.map_(pa.string(), pa.string())), ("image_file", pa.string())])
        held: list[dict] = []
        for batch in batches:
            for path, text in zip(batch["path"], batch["content"], strict=True):
                for k, (values, image) in enumerate(_rows(text.as_py() or "", nested)):
                    held.append({"path": path.as_py(), "rec_no": k, "values": list(values.items()), "image_file": image})
                    if len(held) == _ROWS_AT_ONCE:
                        yield pa.RecordBatch.from_pylist(held, shape)
                        held = []
        yield pa.RecordBatch.from_pylist(held, shape)

    return files.select("path", "content").mapInArrow(work, "path string, rec_no int, values map<string,string>, image_file string")


def parse_defects(files: DataFrame) -> DataFrame:
    """(path, rec_no, values): :func:`defect_rows` of flat lists."""
    return defect_rows(files, False).drop("image_file")


def list_version(content: str = "content") -> Column:
    """The version of a defect list: what it states, else what its form tells."""
    stated = F.concat_ws(".", F.regexp_extract(content, r"FileVersion\s+([0-9]+)\s+([0-9]+)", 1), F.regexp_extract(content, r"FileVersion\s+([0-9]+)\s+([0-9]+)", 2))
    nested = F.col(content).rlike(r"\bList\s+\w+\s*\{")
    return F.when(F.col(content).rlike(r"Record\s+FileRecord"), "1.8").when(stated != ".", stated).when(nested, "1.8").otherwise("1.2")


def is_nested(content: str = "content") -> Column:
    """Whether a list is of the nested form, by its first line that is not blank."""
    return F.regexp_extract(content, r"^\s*([^\r\n]*)", 1).rlike(r"(?i)^record\s+filerecord\b")


def class_names(files: DataFrame) -> DataFrame:
    """(path, number, name): the classes that flat lists name."""
    body = F.regexp_extract("content", r"(?m)^[ \t]*ClassLookup\b[ \t]+[0-9]+[ \t]*\r?\n([^;]*);", 1)
    lines = files.select("path", F.explode(F.split(body, r"\r?\n")).alias("line"))
    number, name = (F.regexp_extract("line", r'^\s*([0-9]+)\s+"?([^"]*?)"?\s*$', k) for k in (1, 2))
    return lines.where(number != "").select("path", number.cast("int").alias("number"), name.alias("name"))


def list_facts(files: DataFrame) -> DataFrame:
    """(path, version, n_lists, first_only, summary): what a flat list says of itself.

    Only the first of several defect lists is read, which ``first_only`` tells; the
    summary's first row is kept as it is stated, by its own columns.
    """
    n = F.size(F.regexp_extract_all("content", F.lit(r"(?m)^[ \t]*DefectList\b[ \t]*\r?$"), F.lit(0)))
    columns = F.split(F.trim(F.regexp_extract("content", r"SummarySpec\s+[0-9]+\s+([^;]+);", 1)), r"\s+")
    values = F.split(F.trim(F.regexp_extract("content", r"(?m)^[ \t]*SummaryList\b[ \t]*\r?\n[ \t]*([^;\r\n]*)", 1)), r"\s+")
    summary = F.map_from_arrays(F.slice(columns, F.lit(1), F.least(F.size(columns), F.size(values))), F.slice(values, F.lit(1), F.least(F.size(columns), F.size(values))))
    return files.select("path", list_version().alias("version"), n.alias("n_lists"), (n > 1).alias("first_only"), summary.alias("summary"))


def parse_lists(files: DataFrame) -> DataFrame:
    """(path, version, rec_no, values, image_file): rows of lists of either form."""
    versions = files.select("path", list_version().alias("version"))
    return defect_rows(files).join(versions, "path").select("path", "version", "rec_no", "values", "image_file")


def die_pitch(files: DataFrame) -> DataFrame:
    """(path, pitch_x_nm, pitch_y_nm): the form in braces is nm, the other um."""
    new, old = (F.regexp_extract("content", _PITCH_NEW, i) for i in (1, 2)), (F.regexp_extract("content", _PITCH_OLD, i) for i in (1, 2))
    return files.select("path", *(F.coalesce(n.try_cast("double"), o.try_cast("double") * 1000).alias(c) for n, o, c in zip(new, old, ("pitch_x_nm", "pitch_y_nm"), strict=True)))


def position_nm(version: Column, value: Column) -> Column:
    """Positions of version 1.2 are um, those of 1.8 nm; text that is no number is null."""
    return value.try_cast("double") * F.when(version == "1.2", 1000.0).otherwise(1.0)


def first_rows(rows: DataFrame, by: str, order: list[str], n: int) -> DataFrame:
    """The first n rows of each group; a limit inside tasks comes before the shuffle."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_k") <= n).drop("_k")


def evenly_spaced(rows: DataFrame, order: str, n: int) -> DataFrame:
    """At most n rows at even distances of the order, the first among them."""
    total = rows.agg(F.count("*").alias("_all"))
    numbered = running_total(rows, order, F.lit(1), "_n").join(F.broadcast(total))
    slot = F.floor(F.col("_n") * n / F.col("_all"))
    before = F.floor((F.col("_n") - 1) * n / F.col("_all"))
    return numbered.where((F.col("_all") <= n) | (F.col("_n") == 0) | (slot > before)).drop("_n", "_all")


def nearest(points: DataFrame, queries: DataFrame, radius: int) -> DataFrame:
    """(query_id, image_id, d2): the nearest point within the radius, if any.

    Points and the boxes around queries meet in grid squares, of which dense ones are
    dealt to parts; of equal distances the later point wins.
    """
    boxes = points.select("*", F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    around = queries.select("*", *((F.col(f"q{a}") + s * radius).alias(f"q{a}{k}") for k, s in ((1, -1), (2, 1)) for a in "xy"))
    d2 = (F.col("x") - F.col("qx")) * (F.col("x") - F.col("qx")) + (F.col("y") - F.col("qy")) * (F.col("y") - F.col("qy"))
    near = bbox_join(boxes, around, 2 * radius).withColumn("d2", d2).where(F.col("d2") <= radius * radius)
    best = F.min(F.struct("d2", (-F.col("image_id")).alias("_id"))).alias("s")
    return near.groupBy("query_id").agg(best).select("query_id", (-F.col("s._id")).alias("image_id"), "s.d2")


def sent_and_read(sent: DataFrame, read: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by key on both sides; what is missing counts zero."""
    return sent.groupBy(*keys).agg(F.count("*").alias("sent")).join(read.groupBy(*keys).agg(F.count("*").alias("read")), keys, "full").na.fill(0, ["sent", "read"])


def parse_nested(files: DataFrame) -> DataFrame:
    """(path, rec_no, values, image_file): :func:`defect_rows` of nested lists."""
    return defect_rows(files, True)


def page_map(images: DataFrame, total: Column) -> DataFrame:
    """(image_id, page, mode): pages by the ids in the list if they can be pages.

    ``ids`` can be pages if none comes twice and all fit ``total`` pages counted
    from 0 or from 1; else pages are dealt out in file order.
    """
    each = images.select(F.explode("ids").alias("id"))
    stats = each.agg(F.min("id").alias("_lo"), F.max("id").alias("_hi"), F.count("id").alias("_n"), F.countDistinct("id").alias("_d"))
    base = F.when((F.col("_lo") == 0) & (F.col("_hi") < total), 0).when((F.col("_lo") >= 1) & (F.col("_hi") <= total), 1)
    rule = stats.select(F.when(F.col("_n") == F.col("_d"), base).alias("_base"))
    placed = running_total(images, "rec_no", F.size("ids"), "_first").join(F.broadcast(rule)).where(F.size("ids") > 0)
    own = F.transform("ids", lambda x: x - F.col("_base"))
    dealt = F.sequence(F.col("_first"), F.col("_first") + F.size("ids") - 1)
    by_id = F.col("_base").isNotNull()
    return placed.select("image_id", F.explode(F.when(by_id, own).otherwise(dealt)).alias("page"), F.when(by_id, "imagelist").otherwise("sequential").alias("mode"))


def up_to(rows: DataFrame, number: str, most: int) -> DataFrame:
    """The records numbered up to ``most``."""
    return rows.where(F.col(number) <= most)


def image_entries(tokens: str, count: Column, start: Column, per_image: Column) -> Column:
    """The values of each image of a row; an empty array if the row is too short for its count."""
    whole = (count > 0) & (F.size(tokens) >= start + count * per_image)
    each = F.transform(F.sequence(F.lit(0).cast("long"), count.cast("long") - 1), lambda k: F.slice(tokens, (start + k * per_image + 1).cast("int"), per_image.cast("int")))
    return F.when(whole, each).otherwise(F.array().cast("array<array<string>>"))


def braced_entries(text: str, count: Column) -> Column:
    """The values of each image in ``Images N {a b, c d}``; an empty array if they are not ``count``."""
    inside = F.regexp_extract(text, r"(?s)^Images?\s+[0-9]+\s*\{(.*)\}\s*$", 1)
    parts = F.filter(F.regexp_extract_all(inside, F.lit('((?:"[^"]*+"|[^",]++)++)'), F.lit(1)), lambda e: F.trim(e) != "")
    each = F.transform(parts, lambda e: F.regexp_extract_all(e, F.lit(r'("[^"]*"|[^\s"]+)'), F.lit(1)))
    return F.when((count > 0) & (F.size(parts) == count), each).otherwise(F.array().cast("array<array<string>>"))


def image_layout(rows: DataFrame, columns: int, count_at: int, list_at: int | None, declared: int | None = None) -> DataFrame:
    """(path, start, per_image, how): where the rows of each list keep their images.

    ``rows`` holds path, rec_no, n_pages and all ``tokens``; ``columns`` are declared,
    the count is one of them and so may be the image list. First come lists whose
    first row with images holds a braced one, then a declared number of values an
    image, then what most rows agree on: values from the list, from past the
    columns, or from the column after the count if it is the last. All but one
    row in ten, or but one, must agree. Of several such starts one wins whose
    first values are whole numbers and never the same.
    """
    with_images = rows.where("n_pages > 0")
    at = list_at if list_at is not None else count_at + 1
    first = with_images.groupBy("path").agg(F.min_by(F.get("tokens", F.lit(at)), "rec_no").alias("_t"))
    braced = first.where("_t = 'Images'").select("path", F.lit(at).alias("start"), F.lit(None).cast("int").alias("per_image"), F.lit("images18").alias("how"))
    rest = with_images.join(braced.select("path"), "path", "left_anti")
    if list_at is not None and declared:
        return braced.unionByName(rest.select("path").distinct().select("path", F.lit(list_at).alias("start"), F.lit(declared).alias("per_image"), F.lit("declared").alias("how")))
    starts = list(dict.fromkeys([*([list_at] if list_at is not None else []), columns, *([columns - 1] if count_at == columns - 2 else [])]))
    tried = rest.select("*", F.posexplode(F.array(*map(F.lit, starts))).alias("_nth", "start"))
    extra = F.size("tokens") - F.col("start")
    votes = tried.where((extra > 0) & (extra % F.col("n_pages") == 0)).groupBy("path", "_nth", "start", (extra / F.col("n_pages")).cast("int").alias("per_image")).agg(F.count("*").alias("votes"))
    total = rest.groupBy("path").agg(F.count("*").alias("total"))
    best = votes.groupBy("path", "_nth", "start").agg(F.max(F.struct("votes", (-F.col("per_image")).alias("_k"))).alias("b")).join(total, "path")
    agreed = best.where(F.col("b.votes") >= F.col("total") - F.greatest(F.lit(1), F.floor(F.col("total") / 10))).select("path", "_nth", "start", (-F.col("b._k")).alias("per_image"))
    names = tried.join(agreed, ["path", "_nth", "start"]).select("path", "_nth", F.explode(F.transform(image_entries("tokens", F.col("n_pages"), F.col("start"), F.col("per_image")), lambda e: e[0])).alias("id"))
    plain = names.groupBy("path", "_nth").agg((F.count_if(~F.col("id").rlike("^-*[0-9]+$")) == 0).alias("_whole"), (F.count("id") == F.countDistinct("id")).alias("_single"))
    ranked = agreed.join(plain, ["path", "_nth"], "left").withColumn("_good", F.coalesce(F.col("_whole") & F.col("_single"), F.lit(False)))
    chosen = ranked.groupBy("path").agg(F.min(F.struct((~F.col("_good")).alias("_bad"), "_nth", "start", "per_image")).alias("b"))
    return braced.unionByName(chosen.select("path", "b.start", "b.per_image", F.lit("inferred").alias("how")))
