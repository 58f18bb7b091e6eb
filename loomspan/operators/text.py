"""From raw pages and extracted lines to clean text and chunks with their section."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from html.parser import HTMLParser
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.functions import strings, urls
from loomspan.operators.isolation import good_rows, isolated
from loomspan.session import bound_batches
from loomspan.sources.readers import with_url

#: Elements that hold no content of a page.
NOISE_ELEMENTS = ("nav", "header", "footer", "aside", "script", "style", "noscript", "iframe", "form")
#: Whole lines that are noise: page numbers, bare addresses, rules.
NOISE_LINES = (
    r"(?mU)^\s*[-–—]?\s*\d{1,4}\s*[-–—]?\s*$",
    r"(?mU)^\s*[Pp][áa]gina\s+\d+\s*(de\s+\d+)?\s*$",
    r"(?mU)^\s*[Pp]age\s+\d+\s*(of\s+\d+)?\s*$",
    r"(?mU)^\s*https?://\S+\s*$",
    r"(?mU)^\s*www\.\S+\s*$",
    r"(?mU)^\s*[-_=·•]{4,}\s*$",
)
#: Characters of a chunk at most, shared with the one before at most, and at least to be kept.
MOST, OVERLAP, LEAST = 1500, 150, 60
#: Where to cut a long section, the best place first.
SEPARATORS = ("\n\n", "\n|", "\n", ". ", " ", "")


def line_pattern(text: str, more: bool = False) -> str:
    """The noise pattern of a line that is only ``text``, or with ``more`` begins with it, whatever its case, for an institution's own headers."""
    return r"(?miU)^\s*\Q" + text + r"\E" + (".*$" if more else r"\s*$")


def body_pattern(body: str, any_case: bool = True) -> str:
    """The noise pattern of a line that ``body``, a regular expression, describes between blanks."""
    return ("(?miU)" if any_case else "(?mU)") + rf"^\s*{body}\s*$"


# ---------------------------------------------------------------- pages


#: The elements that may be a page's main one, the first that is there counts.
MAIN_ELEMENTS = ("main", "article", "#content", "#main-content", ".content", "body")
#: The elements whose texts are blocks, with what stands before them.
BLOCKS = {"h1": "# ", "h2": "## ", "h3": "### ", "h4": "#### ", "li": "- ", "p": "", "td": "", "th": ""}


class _Page(HTMLParser):
    """Collects a page's title, its first heading, its links, and the texts of blocks in order of their beginning."""

    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, list[str] | None, int]] = []
        self.blocks: list[tuple[str, list[str], frozenset[str]]] = []
        self.areas: list[str] = []
        self.seen: set[str] = set()
        self.skipping = 0
        self.titles: list[list[str]] = []
        self.plain_title = True
        self.headings: list[list[str]] = []
        self.links: list[str] = []
        self.skipped_links: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        given = {name: value or "" for name, value in reversed(attrs)}  # the first of repeated attributes counts
        if tag == "a" and "href" in given:
            (self.skipped_links if self.skipping else self.links).append(given["href"])
        if self.stack and self.stack[-1][0] == "title":
            self.plain_title = False
        if tag in self.VOID:
            return
        area = None
        for name, here in zip(MAIN_ELEMENTS, (tag == "main", tag == "article", given.get("id") == "content", given.get("id") == "main-content", "content" in given.get("class", "").split(), tag == "body"), strict=True):
            if here and not self.skipping and name not in self.seen:
                self.seen.add(name)
                self.areas.append(name)
                area = name if area is None else f"{area} {name}"
        texts: list[str] | None = None
        self.skipping += tag in NOISE_ELEMENTS
        if not self.skipping:
            if tag in BLOCKS:
                texts = []
                self.blocks.append((tag, texts, frozenset(self.areas)))
            if tag == "h1":
                self.headings.append(texts)
            if tag == "title":
                texts = []
                self.titles.append(texts)
        self.stack.append((tag, texts, len((area or "").split())))

    def handle_endtag(self, tag: str) -> None:
        if not any(t == tag for t, _, _ in self.stack):
            return
        while self.stack:
            name, _, n_areas = self.stack.pop()
            self.skipping -= name in NOISE_ELEMENTS
            del self.areas[len(self.areas) - n_areas :]
            if name == tag:
                break

    def handle_data(self, data: str) -> None:
        if not self.skipping and data.strip():
            for _, texts, _ in self.stack:
                if texts is not None:
                    texts.append(data.strip())


def parsed(html: str | None) -> dict:
    """A page in one pass: ``title``, ``heading`` (its first of level 1), ``links`` and ``noise_links`` (as written, outside and inside
    of noise elements), and ``body``, the main element's blocks as Markdown lines.

    Character references are decoded, comments and scripts hold no links, and a title with elements in it is none. An element that isn't
    closed holds what follows until one around it is, so blocks within blocks give their texts twice.
    """
    page = _Page()
    page.feed(html or "")
    page.close()
    area = next((a for a in MAIN_ELEMENTS if a in page.seen), None)
    lines = [BLOCKS[tag] + " ".join(texts) for tag, texts, areas in page.blocks if area in areas and texts]
    return {
        "title": " ".join(page.titles[0]) if page.titles and page.plain_title else "",
        "heading": "".join(page.headings[0]) if page.headings else "",
        "links": page.links,
        "noise_links": page.skipped_links,
        "body": "\n\n".join(lines).strip(),
    }


def outline(html: str) -> str:
    """A page's blocks as Markdown lines, from the first of the elements that may be its main one."""
    return parsed(html)["body"]


#: The type of what ``parsed`` gives.
PARSED = "struct<title:string,heading:string,links:array<string>,noise_links:array<string>,body:string>"
parsed_page = isolated(parsed, PARSED)


def _title(page: Column, url: Column) -> Column:
    return strings.first_given(strings.strip(page["title"]), strings.strip(page["heading"]), url)


def page_title(html: Column, url: Column) -> Column:
    """The title, else the first first-level heading, else the address."""
    return _title(parsed_page(html)["value"], url)


def page_links(pages: DataFrame, before_cleaning: bool = False) -> DataFrame:
    """Distinct absolute links of each page, without files that are no pages.

    Links are those outside of noise elements, or all on demand.
    """
    page = pages.select("page_id", "url", parsed_page(F.col("html"))["value"].alias("_p"))
    hrefs = F.concat("_p.links", "_p.noise_links") if before_cleaning else F.col("_p.links")
    found = page.select("page_id", "url", F.explode(hrefs).alias("_href")).withColumn("_href", strings.strip(F.col("_href")))
    link = urls.resolve(F.col("url"), F.col("_href"))
    return found.filter(urls.is_page_link(F.col("_href"))).select("page_id", link.alias("link")).filter(~urls.is_skipped(F.col("link")) & (F.col("link") != "")).distinct()


def page_results(pages: DataFrame, parse: Callable[[Column], Column] = parsed_page) -> DataFrame:
    """Each page's title and Markdown, or the ``error`` that its parsing ended with; one page's failure leaves the others.

    The Markdown begins with a first-level heading or is empty. ``parse`` gives a struct of value and error.
    """
    got = pages.select("page_id", "url", parse(F.col("html")).alias("_r"))
    body = F.col("_r.value.body")
    title = _title(F.col("_r.value"), F.col("url"))
    headed = F.when((body == "") | F.startswith(body, F.lit("# ")), body).otherwise(F.concat(F.lit("# "), title, F.lit("\n\n"), body))
    fine = F.col("_r.error").isNull()
    return got.select("page_id", "url", F.when(fine, title).alias("title"), F.when(fine, headed).alias("markdown"), F.col("_r.error").alias("error"))


def page_markdown(pages: DataFrame) -> DataFrame:
    """Each page's title and Markdown; pages that can't be parsed are left out, ``page_results`` has them."""
    return good_rows(page_results(pages))


# ---------------------------------------------------------------- cleaning


def clean_noise(text: Column, patterns: tuple[str, ...] = NOISE_LINES) -> Column:
    """Without noise lines, and with at most one blank line in a row."""
    for pattern in patterns:
        text = F.regexp_replace(text, pattern, "")
    return F.regexp_replace(text, r"\n{3,}", "\n\n")


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once a row however often it is used: functions of arrays would otherwise
    take it in, and compute it anew for every element."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def keep_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = 2) -> DataFrame:
    """Each text with at most ``most`` of a run of equal lines, and how many lines stay and go.

    Lines are compared without surrounding white space; blank lines always stay
    and end a run. A line goes if it equals each of the ``most`` lines before it, which takes no shuffle. A null text has no lines and stays empty.
    """
    none = F.array().cast("array<string>")
    lines = _once(docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text")), "_lines", F.coalesce(strings.split_lines(F.col("_text")), none))
    bare = _once(lines, "_bare", F.transform("_lines", strings.strip))

    def stays(line: Column, i: Column) -> Column:
        equal = reduce(and_, [F.coalesce(F.get("_bare", i - k) == F.get("_bare", i), F.lit(False)) for k in range(1, most + 1)])
        return (F.get("_bare", i) == "") | ~equal

    kept = _once(bare, "_kept", F.filter("_lines", stays))
    n_kept = F.size("_kept").cast("long")
    return kept.select(key, n_kept.alias("n_kept"), (F.size("_lines") - n_kept).alias("n_dropped"), F.array_join("_kept", "\n").alias("text"))


def finish(text: Column) -> Column:
    """Trimmed, and ended by one line end."""
    return F.concat(strings.strip(text), F.lit("\n"))


def noise_removed(raw: Column, clean: Column) -> Column:
    """The percentage of characters that cleaning took away."""
    return F.round((F.lit(1) - F.char_length(clean) / F.greatest(F.char_length(raw), F.lit(1))) * 100, 1)


# ---------------------------------------------------------------- extracted words and tables


def table_rows(table: Column) -> Column:
    """An array of arrays of cells as Markdown table rows, with a rule after the first; empty for no rows."""
    cell = lambda c: strings.strip(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")))
    rows = F.transform(table, lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, cell), " | "), F.lit(" |")))
    rule = F.concat(F.lit("|"), F.array_join(F.transform(F.get(table, F.lit(0)), lambda c: F.lit(" --- ")), "|"), F.lit("|"))
    return F.when(F.size(table) < 1, "").otherwise(F.array_join(F.concat(F.slice(rows, 1, 1), F.array(rule), F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1)))), "\n"))


def upper_median(values: Column) -> Column:
    """Of an array of sizes the middle one, the upper of two; 10 for none."""
    ordered = F.array_sort(values)
    return F.coalesce(F.get(ordered, F.floor(F.size(ordered) / 2).cast("int")), F.lit(10.0))


def upper_median_of(column: str) -> Column:
    """The same as an aggregate; its state is a count per distinct value."""
    return F.coalesce(F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{column}` DESC)"), F.lit(10.0))


def heading_mark(line: Column, size: Column, median: Column) -> Column:
    """The heading mark that a line's mean font size and capitals suggest; null for none."""
    text = strings.strip(line)
    ratio = size / F.greatest(median, F.lit(1.0))
    caps = (text == F.upper(text)) & text.rlike(r"\p{Lu}") & (F.size(strings.split_words(text)) <= 10)
    mark = (
        F.when((ratio >= 1.6) | (caps & (ratio >= 1.2)), "#")
        .when(ratio >= 1.3, "##")
        .when((ratio >= 1.15) | (caps & (ratio >= 1.0) & (F.char_length(text) < 80)), "###")
    )
    return F.when((text != "") & (F.char_length(text) <= 150) & size.isNotNull(), mark)


def word_lines(words: DataFrame, boxes: DataFrame | None = None) -> DataFrame:
    """Words (page, text, x, top, bottom, size) gathered to lines by their height on the page.

    With a column ``doc`` in ``words``, and in ``boxes``, pages are told apart by document. Words whose middle lies within a table's
    box (page, x0, x1, top, bottom) are left out; a word's right end is in ``x1``, or it ends where it begins. Lines come
    with their mean size and the gap to the line above.
    """
    by = [c for c in ("doc", "page") if c in words.columns]
    right = F.coalesce("x1", "x") if "x1" in words.columns else F.col("x")
    middle = words.withColumns({"_mx": (F.col("x") + right) / 2, "_my": (F.col("top") + F.col("bottom")) / 2})
    if boxes is not None:
        b = boxes.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("x0").alias("_x0"), F.col("x1").alias("_x1"), F.col("top").alias("_t"), F.col("bottom").alias("_b"))
        same = reduce(and_, [F.col(c) == F.col(f"_{c}") for c in by])
        middle = middle.join(b, same & F.col("_mx").between(F.col("_x0"), F.col("_x1")) & F.col("_my").between(F.col("_t"), F.col("_b")), "left_anti")
    row = (F.bround(F.col("top") / 2) * 2).alias("row")
    placed = F.array_sort(F.collect_list(F.struct("x", "text")))
    lines = middle.groupBy(*by, row).agg(
        F.array_join(F.transform(placed, lambda w: w["text"]), " ").alias("line"), F.avg("size").alias("size"), F.max_by("bottom", F.struct("x", "text")).alias("bottom")
    )
    above = F.lag("bottom").over(Window.partitionBy(*by).orderBy("row"))
    return lines.withColumn("gap", F.col("row") - above)


#: What begins an item of a list: a bullet, or a marker.
BULLET, MARKER = r"^[•·▪▸\-]\s", r"^(\w\)|\d+[.)])\s"


def is_list_item(line: Column) -> Column:
    text = strings.strip(line)
    return text.rlike("(?U)" + BULLET) | text.rlike("(?U)" + MARKER)


def list_line(line: Column) -> Column:
    """A line as Markdown: an item begins with a hyphen, which takes a bullet's place and stands before a marker; others stay."""
    text = strings.strip(line)
    bare = F.concat(F.lit("- "), strings.strip(F.substr(text, F.lit(3))))
    return F.when(text.rlike("(?U)" + BULLET), bare).when(text.rlike("(?U)" + MARKER), F.concat(F.lit("- "), text)).otherwise(line)


def page_text(lines: DataFrame) -> DataFrame:
    """Lines of ``word_lines`` as each page's Markdown in ``text``: headings by the document's or page's median size, items, and a blank
    line where the gap is over one and a half median sizes."""
    by = [c for c in ("doc", "page") if c in lines.columns]
    medians = lines.groupBy(*by).agg(upper_median_of("size").alias("_median"))
    rows = lines.join(medians, by)
    mark = heading_mark(F.col("line"), F.col("size"), F.col("_median"))
    shown = F.when(mark.isNotNull(), F.concat(F.lit("\n"), mark, F.lit(" "), strings.strip(F.col("line")), F.lit("\n"))).otherwise(list_line(F.col("line")))
    spaced = F.concat(F.when(F.col("gap") > F.col("_median") * 1.5, F.lit("\n")).otherwise(F.lit("")), shown)
    ordered = F.array_sort(F.collect_list(F.struct(F.col("row").alias("r"), spaced.alias("t"))))
    return rows.groupBy(*by).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "\n").alias("text"))


def joined_pages(pages: DataFrame, key: str = "doc", page: str = "page", text: str = "text") -> DataFrame:
    """A document's pages in order with a rule between them; blank pages are left out."""
    full = pages.filter(strings.strip(F.col(text)) != "")
    ordered = F.array_sort(F.collect_list(F.struct(page, text)))
    return full.groupBy(key).agg(F.array_join(F.transform(ordered, lambda p: p[text]), "\n\n---\n\n").alias(text))


# ---------------------------------------------------------------- chunks


def document_title(markdown: Column, stem: Column) -> Column:
    """The first first-level heading, else the file's name with its escapes and joiners undone."""
    heading = strings.strip(F.regexp_extract(markdown, r"(?m)^\s*#\s+(.+)", 1))
    plain = F.coalesce(F.try_url_decode(F.replace(stem, F.lit("+"), F.lit("%2B"))), stem)
    return strings.first_given(heading, strings.strip(F.regexp_replace(plain, "[_-]", " ")))


def sections(docs: DataFrame, key: str = "doc_id", text: str = "text", carried: Sequence[str] = ()) -> DataFrame:
    """A text cut at its headings of levels 1 to 3, each section with the headings above it, and with the ``carried`` columns of its text.

    Headings within fenced code are text. A heading's line stays in its section.
    """
    in_order = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = docs.select(key, *carried, F.posexplode(strings.split_lines(F.col(text))).alias("pos", "line"))
    fenced = F.sum(F.col("line").rlike(r"^\s*(```|~~~)").cast("int")).over(in_order) % 2 == 1
    level = F.when(~fenced, F.nullif(F.length(F.regexp_extract("line", r"^\s*(#{1,3})\s+\S", 1)), F.lit(0)))
    lines = lines.withColumn("_level", level)
    name = strings.strip(F.regexp_extract("line", r"^\s*#{1,3}\s+(.*)$", 1))
    columns: dict[str, Column] = {}
    for n in (1, 2, 3):
        columns[f"_h{n}"] = F.last(F.when(F.col("_level") == n, F.struct("pos", name.alias("name"))), ignorenulls=True).over(in_order)
    columns["_section"] = F.sum(F.coalesce((F.col("_level") > 0).cast("int"), F.lit(0))).over(in_order)
    lines = lines.withColumns(columns)
    above = F.lit(-1)
    for n in (1, 2, 3):  # a heading holds until one of a higher level follows
        here = F.col(f"_h{n}")
        lines = lines.withColumn(f"header_{n}", F.when(here["pos"] > above, here["name"]))
        above = F.greatest(above, F.coalesce(here["pos"], F.lit(-1)))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "line")))
    body = F.array_join(F.transform(ordered, lambda x: x["line"]), "\n")
    return (
        lines.groupBy(key, "_section", *carried)
        .agg(*[F.first(f"header_{n}").alias(f"header_{n}") for n in (1, 2, 3)], strings.strip(body).alias("text"))
        .filter(F.col("text") != "")
        .withColumnRenamed("_section", "section_no")
    )


def section_path(*headers: Column) -> Column:
    return F.concat_ws(" > ", *[F.nullif(strings.strip(h), F.lit("")) for h in headers])


def cut(text: str, most: int = MOST, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """A long text in pieces of at most ``most`` characters, cut at the best separator that serves.

    Pieces are packed together up to the limit; a piece begins with up to
    ``overlap`` characters of the one before. Pieces too long by themselves are
    cut at the next separator.
    """
    if len(text) <= most:
        return [text] if text.strip() else []
    at = next((i for i, s in enumerate(separators) if not s or s in text), len(separators) - 1)
    sep = separators[at]
    parts = [text[i : i + most - overlap] for i in range(0, len(text), most - overlap)] if not sep else text.split(sep)
    if sep:
        parts = [parts[0]] + [sep + p for p in parts[1:]]  # a separator opens the part it stands before
    out: list[str] = []
    held: list[str] = []
    size = 0

    def close() -> None:
        if held and "".join(held).strip():
            out.append("".join(held).strip())

    for part in parts:
        if len(part) > most:
            close()
            held, size = [], 0
            out += cut(part, most, overlap, separators[at + 1 :] or ("",))
            continue
        if size + len(part) > most:
            close()
            while held and (size > overlap or size + len(part) > most):
                size -= len(held.pop(0))
        held.append(part)
        size += len(part)
    close()
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def _cuts(text: pd.Series) -> pd.Series:
    return text.map(lambda t: cut(t or ""))


def chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", carried: Sequence[str] = ()) -> DataFrame:
    """Chunks of each text with their section and their place in it, and with the ``carried`` columns, such as title, source_file and source_url.

    The place is given before short chunks go, so it may have gaps. Sections
    within the limit skip the splitter.
    """
    bound_batches(docs.sparkSession)
    parts = sections(docs, key, text, carried).withColumn("section", section_path(*[F.col(f"header_{n}") for n in (1, 2, 3)]))
    pieces = F.when(F.char_length("text") > MOST, _cuts(F.col("text"))).otherwise(F.array("text"))
    return (
        parts.select(key, *carried, "section_no", "section", F.posexplode(pieces).alias("chunk_index", "chunk"))
        .withColumn("chunk", strings.strip(F.col("chunk")))
        .filter(F.char_length("chunk") >= LEAST)
        .withColumn("id", F.sha2("chunk", 256))
    )


def file_chunks(files: DataFrame, sources: DataFrame, name: str = "name", text: str = "text") -> DataFrame:
    """Chunks of Markdown files with title, source_file and source_url: the URL known for the PDF of the same stem, else for the file, else empty.

    ``sources`` has name and url, as ``url_maps`` reads them.
    """
    titled = files.select(F.col(name).alias("name"), F.col(text).alias("text")).withColumn("title", document_title(F.col("text"), F.regexp_replace("name", r"\.md$", "")))
    known = with_url(titled, sources).withColumnRenamed("name", "source_file")
    return chunks(known, "source_file", "text", ("title", "source_url"))


def facts(files: DataFrame, text: str = "value") -> DataFrame:
    """One chunk per line that isn't blank, numbered by its place among these."""
    kept = F.filter(F.transform(strings.split_lines(F.col(text)), strings.strip), lambda x: x != "")
    return files.select(*[c for c in files.columns if c != text], F.posexplode(kept).alias("chunk_index", "text"))


def chunk_lengths(length: Column) -> list[Column]:
    """Aggregates over chunks: how many, and their mean (rounded down), longest and shortest length."""
    n = F.count(F.lit(1))
    return [n.alias("n"), F.floor(F.sum(length) / n).cast("long").alias("avg_len"), F.max(length).cast("long").alias("max_len"), F.min(length).cast("long").alias("min_len")]
