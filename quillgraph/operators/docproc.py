"""Documents to structure: pages, fragments, headings, chunks, tables of contents, glossaries, bundles and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.config import DEFAULT
from quillgraph.functions import patterns as P
from quillgraph.functions import text as T


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, pos, content of every line."""
    return docs.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "content"))


def running_page(rows: DataFrame, group: str, position: str, is_break: Column) -> DataFrame:
    """Adds page: one more than the breaks up to and with this row."""
    return rows.withColumn("page", 1 + F.sum(is_break.cast("int")).over(Window.partitionBy(group).orderBy(position)))


def virtual_pages(rows: DataFrame, group: str, position: str, content: str, page_size: int = DEFAULT.virtual_page) -> DataFrame:
    """Adds page from the characters before a row."""
    before = Window.partitionBy(group).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.length(F.coalesce(F.col(content), F.lit("")))).over(before), F.lit(0))
    return rows.withColumn("page", (F.floor(offset / page_size) + 1).cast("long"))


def reattach_fragments(rows: DataFrame, group: list[str], position: str, content: str = "content") -> DataFrame:
    """Fragments appended to the last paragraph before them in their section; leading ones stay by themselves.

    Returns the groups, ``start`` (position of the paragraph) and the joined content.
    """
    order = Window.partitionBy(*group).orderBy(position)
    fragment = T.is_fragment(F.col(content)) & (F.row_number().over(order) > 1)
    rows = rows.withColumn("_f", fragment)
    rows = rows.withColumn("_island", F.sum((~F.col("_f")).cast("int")).over(order))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.trim(content).alias("c")))), lambda x: x["c"]), " ")
    return rows.groupBy(*group, "_island").agg(F.min(position).alias("start"), joined.alias("content")).drop("_island")


def nest_sections(sections: DataFrame, group: str, position: str, level: str = "level", deepest: int = 6) -> DataFrame:
    """Adds parent_position: the last earlier section of a lower level, by the running maximum for each lower level.

    Each level is one window function over the document's sections. Headings have six levels; a layout with more says
    how many by ``deepest``, and a section below that is an error.
    """
    before = Window.partitionBy(group).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    last = {k: F.max(F.when(F.col(level) == k, F.col(position))).over(before) for k in range(1, deepest)}
    none = F.lit(None).cast(sections.schema[position].dataType)
    parent = F.when(F.col(level) > deepest, F.raise_error(F.concat(F.lit(f"a section below level {deepest}: "), F.col(level).cast("string"))).cast(sections.schema[position].dataType)).otherwise(none)
    for k in range(2, deepest + 1):
        parent = F.when(F.col(level) == k, F.greatest(none, none, *[last[j] for j in range(1, k)])).otherwise(parent)
    return sections.withColumn("parent_position", parent)


def normalise_levels(sections: DataFrame, group: str, position: str, level: str = "level", deepest: int = 6) -> DataFrame:
    """Levels without gaps: a section is one level below its parent (``parent_position``), and roots keep theirs.

    A heading has at most six levels, so its ancestors are found in as many joins.
    """
    up = sections.select(group, F.col(position).alias("_at"), F.col("parent_position").alias("_next"), F.col(level).alias("_level"))
    rows = sections.withColumns({"_up": F.col("parent_position"), "_new": F.col(level), "_depth": F.lit(0)})
    for _ in range(deepest - 1):
        rows = rows.join(up.withColumnRenamed("_at", "_up"), [group, "_up"], "left")
        found = F.col("_level").isNotNull()
        rows = rows.withColumns({"_new": F.coalesce("_level", "_new"), "_depth": F.col("_depth") + found.cast("int"), "_up": F.col("_next")}).drop("_level", "_next")
    return rows.withColumn(level, F.col("_new") + F.col("_depth")).select(*sections.columns)


def as_markdown(results: DataFrame) -> DataFrame:
    """document_id, body: an answer's paragraphs under their documents and sections, in the order of their scores.

    results: document_id, document_title, section_title, section_level, content, rank (from 1, the best).
    """
    head = F.when(F.col("section_title").isNotNull(), F.concat(F.repeat(F.lit("#"), F.least(F.coalesce("section_level", F.lit(1)) + 1, F.lit(6))), F.lit(" "), F.col("section_title"), F.lit("\n\n"))).otherwise(F.lit(""))
    parts = results.groupBy("document_id", "document_title", "section_title", "section_level").agg(F.min("rank").alias("rank"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda x: x["content"]), "\n\n").alias("text"))
    parts = parts.withColumn("block", F.concat(head, F.col("text")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"]), "\n\n")
    return parts.groupBy("document_id", "document_title").agg(F.concat(F.lit("# "), F.first("document_title"), F.lit("\n\n"), joined).alias("body"), F.min("rank").alias("rank"))


def markdown_headings(pages: DataFrame, key: str, markdown: str) -> DataFrame:
    """key, pos, level, title of the heading lines."""
    rows = pages.select(key, F.posexplode(F.split(F.col(markdown), "\n")).alias("pos", "line"))
    rows = rows.where(F.col("line").rlike(r"^#{1,6} \S"))
    return rows.select(key, "pos", F.length(F.regexp_extract("line", "^(#+)", 1)).alias("level"), F.trim(F.regexp_replace("line", "^#+ ", "")).alias("title"))


def bundle_by_host(pages: DataFrame, url: str = "url", content: str = "content", key: str | None = None) -> DataFrame:
    """host, n_pages, content: all pages of a host as one document, in order of their addresses, those of one address in order of ``key``
    (if given), then of their contents; without an address they are last. Pages without contents add nothing, and a host of such only has none."""
    rows = pages.withColumn("host", T.hostname(F.col(url)))
    ties = [F.col(key).alias("k")] if key else []
    listed = F.collect_list(F.when(F.col(content).isNotNull(), F.struct(F.col(url).isNull().alias("none"), F.col(url).alias("u"), *ties, F.col(content).alias("c"))))
    joined = F.when(F.size(listed) > 0, F.array_join(F.transform(F.array_sort(listed), lambda x: x["c"]), "\n\n"))
    return rows.groupBy("host").agg(F.count("*").alias("n_pages"), joined.alias("content"))


def chunk_markdown(
    docs: DataFrame, key: str, text: str, most: int = DEFAULT.chunk_chars, least: int = DEFAULT.chunk_least, page_size: int = DEFAULT.virtual_page
) -> DataFrame:
    """key, chunk, heading, heading_level, start_page, end_page, page_source, text: pieces of about ``most`` characters.

    A chunk ends before a heading (levels 1 to 3) once over a quarter full, and once it is full. Pages are counted at
    lines of five hyphens or more; without any they are stretches of ``page_size`` characters. A chunk of fewer than
    ``least`` characters joins the one before it, the first one the one after it, where both fit into ``most``.

    The two folds look at sizes only and grow a list only where a piece begins; all else is slices of the document's
    lines, so a document is read where it lies and nothing is shuffled. A null text is empty and has no chunk.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), F.split(F.coalesce(F.col(text), F.lit("")), r"\r?\n").alias("lines"))
    heading, rule = r"^\s{0,3}(#{1,3})\s+(\S.*)$", r"^-{5,}\s*$"
    sized = F.transform("lines", lambda x, i: F.struct(i.alias("at"), (F.length(x) + 1).alias("n"), x.rlike(r"^\s{0,3}#{1,3}\s").alias("head"), x.rlike(rule).cast("int").alias("ends_page")))

    def next_line(state: Column, x: Column) -> Column:
        full = (state["size"] >= most) | (x["head"] & (state["size"] > most / 4))
        begins = F.array_append(state["begins"], F.struct(x["at"].alias("at"), state["page"].alias("page")))
        return F.struct(
            (F.when(full, 0).otherwise(state["size"]) + x["n"]).alias("size"), (state["page"] + x["ends_page"]).alias("page"), F.when(full, begins).otherwise(state["begins"]).alias("begins")
        )

    start = F.struct(F.lit(0).alias("size"), F.lit(1).alias("page"), F.array(F.struct(F.lit(0).alias("at"), F.lit(1).alias("page"))).alias("begins"))
    rows = rows.withColumn("cut", F.aggregate(sized, start, next_line))
    last = F.array(F.struct(F.size("lines").alias("at"), F.col("cut.page").alias("page")))
    ends = F.concat(F.slice("cut.begins", 2, F.size("cut.begins")), last)
    piece = lambda b, e: F.slice("lines", b["at"] + 1, e["at"] - b["at"])
    title = lambda b, e: F.get(F.filter(piece(b, e), lambda x: x.rlike(heading)), F.lit(0))
    parts = F.zip_with("cut.begins", ends, lambda b, e: F.struct(F.concat(F.array_join(piece(b, e), "\n"), F.lit("\n")).alias("text"), title(b, e).alias("head"), b["page"].alias("first"), e["page"].alias("last")))
    rows = rows.select("key", F.col("cut.page").alias("pages"), F.filter(parts, lambda p: p["text"].rlike(r"\S")).alias("parts"))

    def next_part(state: Column, x: Column) -> Column:
        joins = (x["at"] > 0) & (x["n"] < least) & (state["size"] + x["n"] <= most)
        begins = F.array_append(state["begins"], F.struct(x["at"].alias("at"), state["total"].alias("before"), x["n"].alias("n")))
        return F.struct((F.when(joins, state["size"] + 1).otherwise(0) + x["n"]).alias("size"), (state["total"] + x["n"]).alias("total"), F.when(joins, state["begins"]).otherwise(begins).alias("begins"))

    lengths = F.transform("parts", lambda p, i: F.struct(i.alias("at"), F.length(p["text"]).alias("n")))
    start = F.struct(F.lit(0).alias("size"), F.lit(0).alias("total"), F.array().cast("array<struct<at:int,before:int,n:int>>").alias("begins"))
    rows = rows.withColumn("cut", F.aggregate(lengths, start, next_part))
    last = F.array(F.struct(F.size("parts").alias("at"), F.col("cut.total").alias("before"), F.lit(0).alias("n")))
    ends = F.concat(F.slice("cut.begins", 2, F.size("cut.begins")), last)
    spans = F.zip_with("cut.begins", ends, lambda b, e: F.struct(b.alias("b"), e.alias("e")))
    rows = rows.select("key", "pages", "parts", F.when(F.size("parts") > 0, spans).alias("spans"))
    # A short first chunk takes the second in.
    two = lambda k: F.aggregate(F.slice("parts", F.get("spans", F.lit(k))["b"]["at"] + 1, F.get("spans", F.lit(k))["e"]["at"] - F.get("spans", F.lit(k))["b"]["at"]), F.lit(-1), lambda n, p: n + 1 + F.length(p["text"]))
    short = (F.size("spans") > 1) & (two(0) < least) & (two(0) + two(1) <= most)
    joined = F.concat(F.array(F.struct(F.get("spans", F.lit(0))["b"].alias("b"), F.get("spans", F.lit(1))["e"].alias("e"))), F.slice("spans", 3, F.size("spans")))
    rows = rows.select("key", "pages", "parts", F.when(short, F.get("spans", F.lit(1))["b"]["at"]).otherwise(F.lit(0)).alias("lead"), F.when(F.coalesce(short, F.lit(False)), joined).otherwise(F.col("spans")).alias("spans"))
    # An outer explode: a filter on the lists would be pushed down and would build them once more.
    rows = rows.select("key", "pages", "parts", "lead", F.posexplode_outer("spans").alias("chunk", "span")).where("chunk IS NOT NULL")
    own = F.slice("parts", F.col("span.b.at") + 1, F.col("span.e.at") - F.col("span.b.at"))
    head = F.coalesce(F.when(F.col("chunk") == 0, F.get("parts", F.col("lead"))["head"]), F.get(own, F.lit(0))["head"])
    paged = F.col("pages") > 1
    virtual = lambda n: F.floor(n / page_size).cast("int") + 1
    return rows.select(
        "key", "chunk", F.trim(F.nullif(F.regexp_extract(head, heading, 2), F.lit(""))).alias("heading"), F.when(head.isNotNull(), F.length(F.regexp_extract(head, heading, 1))).alias("heading_level"),
        F.when(paged, F.get(own, F.lit(0))["first"]).otherwise(virtual(F.col("span.b.before"))).alias("start_page"),
        F.when(paged, F.element_at(own, -1)["last"]).otherwise(virtual(F.col("span.e.before"))).alias("end_page"),
        F.when(paged, "physical").otherwise("virtual").alias("page_source"), F.array_join(F.transform(own, lambda p: p["text"]), "\n").alias("text"),
    )


def _marked_blocks(rows: DataFrame, group: str, position: str, content: str, opens: str) -> DataFrame:
    """Lines of blocks that begin with a heading of a pattern, up to the next heading: block numbers them, head marks the first."""
    order = Window.partitionBy(group).orderBy(position)
    heading = F.coalesce(F.col(content).rlike(r"^#{1,4}\s+"), F.lit(False))
    rows = rows.withColumns({"head": F.coalesce(F.col(content).rlike(opens), F.lit(False)), "_h": heading}).withColumn("block", F.sum(F.col("_h").cast("int")).over(order))
    return rows.withColumn("_in", F.max("head").over(Window.partitionBy(group, "block"))).where("_in").drop("_in", "_h")


def table_of_contents(rows: DataFrame, group: str, position: str, content: str = "content", least_run: int = 5) -> DataFrame:
    """group, entry, title, level, page of the contents blocks of documents, and of runs of contents lines without a heading.

    Below a contents heading, until the next heading or a third blank line in a row: links and numbered bold titles are
    chapters without a page, dotted lines are entries with one; the pages found in the block are dealt to the chapters
    in order. A document without such a heading: runs of ``least_run`` contents lines or more (blank lines don't end one).
    """
    order = Window.partitionBy(group, "block").orderBy(position)
    text = F.col(content)
    block = _marked_blocks(rows, group, position, content, P.TOC_HEADING)
    blank = (F.trim(text) == "").cast("int")
    third = F.sum(blank).over(order.rowsBetween(-2, 0)) == 3
    block = block.withColumn("_over", F.max(third).over(order)).where(~F.col("_over") & ~F.col("head"))
    kind = F.when(text.rlike(P.TOC_LINK), "link").when(text.rlike(P.TOC_BOLD), "bold").when(text.rlike(P.TOC_DOTTED), "dotted").when(text.rlike(P.TOC_BOLD_PAGE), "page")
    block = block.withColumn("kind", kind).where(F.col("kind").isNotNull())
    part = lambda pattern, k: F.regexp_extract(text, pattern, k)
    title = F.when(F.col("kind") == "link", part(P.TOC_LINK, 1)).when(F.col("kind") == "bold", F.regexp_replace(F.trim(part(P.TOC_BOLD, 2)), r"\.+$", "")).otherwise(F.regexp_replace(part(P.TOC_DOTTED, 1), r"\*+", ""))
    page = F.when(F.col("kind") == "dotted", part(P.TOC_DOTTED, 2)).when(F.col("kind") == "page", part(P.TOC_BOLD_PAGE, 1))
    block = block.withColumns({"title": F.trim(title), "page": F.try_to_number(page, F.lit("999999999")).cast("int")})
    # The k-th chapter of a block gets its k-th page.
    chapters = block.where(F.col("kind").isin("link", "bold")).withColumn("k", F.row_number().over(order)).select(group, "block", position, "title", F.lit(1).alias("level"), "k")
    pages = block.where(F.col("page") >= 1).withColumn("k", F.row_number().over(order)).select(group, "block", "k", "page")
    dealt = chapters.join(pages, [group, "block", "k"], "left").select(group, position, "title", "level", "page")
    dotted = block.where((F.col("kind") == "dotted") & (F.length("title") > 1)).select(group, position, "title", F.lit(2).alias("level"), "page")
    found = dealt.unionByName(dotted)
    # Runs of contents lines, in documents that have no block.
    whole = Window.partitionBy(group).orderBy(position)
    line = F.coalesce(text.rlike(P.TOC_LINE), F.lit(False))
    runs = rows.withColumns({"_e": line, "_b": F.coalesce(F.trim(text) == "", F.lit(True))}).withColumn("_run", F.sum((~F.col("_e") & ~F.col("_b")).cast("int")).over(whole)).where("_e")
    runs = runs.withColumn("_n", F.count("*").over(Window.partitionBy(group, "_run"))).where(F.col("_n") >= least_run)
    first = runs.groupBy(group).agg(F.min("_run").alias("_run"))
    runs = runs.join(first, [group, "_run"]).join(found.select(group).distinct(), group, "left_anti")
    linked = text.rlike(r"\[.+?\]")
    listed = runs.select(group, position, F.trim(F.when(linked, part(r"\[(.+?)\]", 1)).otherwise(part(P.TOC_NUMBERED, 1))).alias("title"), F.lit(1).alias("level"), F.when(~linked, F.try_to_number(part(P.TOC_NUMBERED, 2), F.lit("999999999"))).cast("int").alias("page"))
    return found.unionByName(listed.where("title <> ''")).select(group, F.col(position).alias("entry"), "title", "level", "page")


def glossary(rows: DataFrame, group: str, position: str, content: str = "content") -> DataFrame:
    """group, term, definition of the lines below a glossary heading, up to the next one: bold terms, terms with a colon, table rows."""
    text = F.col(content)
    block = _marked_blocks(rows, group, position, content, P.GLOSSARY_HEADING).where("NOT head")
    which = F.when(text.rlike(P.GLOSSARY_BOLD), F.lit(P.GLOSSARY_BOLD)).when(text.rlike(P.GLOSSARY_COLON), F.lit(P.GLOSSARY_COLON)).when(text.rlike(P.GLOSSARY_TABLE) & ~text.rlike(r"^[\s|:-]+$"), F.lit(P.GLOSSARY_TABLE))
    part = lambda k: F.trim(F.when(which == P.GLOSSARY_BOLD, F.regexp_extract(text, P.GLOSSARY_BOLD, k)).when(which == P.GLOSSARY_COLON, F.regexp_extract(text, P.GLOSSARY_COLON, k)).otherwise(F.regexp_extract(text, P.GLOSSARY_TABLE, k)))
    return block.where(which.isNotNull()).select(group, part(1).alias("term"), part(2).alias("definition"))


def link_contents(entries: DataFrame, sections: DataFrame) -> DataFrame:
    """TOC_REF: each entry to the first section of its document with its page or its title.

    entries: document_id, entry, title, page; sections: document_id, node_id, title, page, doc_position.
    """
    low = lambda c: F.lower(F.trim(c))
    s = sections.select("document_id", F.col("node_id").alias("section_id"), low("title").alias("_t"), F.col("page").alias("_p"), "doc_position")
    by_page = entries.where(F.col("page").isNotNull()).join(s.drop("_t").withColumnRenamed("_p", "page"), ["document_id", "page"])
    by_title = entries.withColumn("_t", low("title")).join(s.drop("_p"), ["document_id", "_t"])
    rows = by_page.select("document_id", "entry", "section_id", "doc_position").unionByName(by_title.select("document_id", "entry", "section_id", "doc_position"))
    return rows.groupBy("document_id", "entry").agg(F.min_by("section_id", F.struct("doc_position", "section_id")).alias("section_id"))


def wiki_pages(docs: DataFrame, sections: DataFrame) -> DataFrame:
    """path, body of a page for each document: its title, then its section titles as links in order."""
    link = F.concat(F.lit("- ["), F.col("title"), F.lit("]("), T.wiki_slug(F.col("title")), F.lit(".md)"))
    listed = sections.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_position", link.alias("l")))), lambda x: x["l"]), "\n").alias("links"))
    rows = docs.join(listed, "document_id", "left")
    body = F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"), F.coalesce("links", F.lit("")))
    return rows.select("document_id", F.concat(T.wiki_slug(F.col("title")), F.lit("/index.md")).alias("path"), body.alias("body"))


def crawl_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """url, link of every address in a page, absolute, without fragments, http and https only."""
    hrefs = F.regexp_extract_all(html, F.lit(r"""(?i)<a\s[^>]*?href=["']([^"'#]+)"""), F.lit(1))
    rows = pages.select(url, F.explode(F.array_distinct(hrefs)).alias("href"))
    origin = F.regexp_extract(url, r"^(https?://[^/]+)", 1)
    base = F.regexp_extract(url, r"^(https?://[^/]+(?:/[^?#]*/|/)?)", 1)
    link = F.when(F.col("href").rlike("^https?://"), F.col("href")).when(F.col("href").startswith("/"), F.concat(origin, F.col("href"))).when(F.col("href").rlike("^[a-z]+:"), None)
    return rows.select(url, link.otherwise(F.concat(base, F.col("href"))).alias("link")).where(F.col("link").isNotNull())


def crawl_frontier(pages: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """url, depth of pages within so many same-host links of the start pages; a loop over the few depths."""
    links = crawl_links(pages).where(T.hostname(F.col("url")) == T.hostname(F.col("link")))
    known = pages.select("url").distinct()
    found = start.select("url").distinct().withColumn("depth", F.lit(0))
    front = found
    for k in range(1, depth + 1):
        step = front.select("url").join(links, "url").select(F.col("link").alias("url")).distinct().join(known, "url", "left_semi")
        front = step.join(found.select("url"), "url", "left_anti").withColumn("depth", F.lit(k))
        found = found.unionByName(front)
    return found


def is_blocked(html: Column) -> Column:
    """Pages that a bot check answered instead of the site."""
    return F.coalesce((F.length(html) < 20000) & html.rlike("(?i)captcha|access denied|verify you are (a )?human|just a moment|enable javascript and cookies"), F.lit(False))
