"""Label documents to claims: packs, reserve tables, sanctions XML, page islands, tag lists.

Documents arrive as rows (path, content), as ``binaryFile`` or ``wholetext`` reads give them, so
one job parses any number of sources. A document that its rules refuse gives rows of
:func:`refused` with a reason and no claims.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import families

CLAIM = ["path", "chain", "address", "entity", "category", "role", "confidence", "method", "source", "source_date"]
ROLES = ("deposit", "hot", "cold", "withdrawal", "operator", "unknown")
ACTIONABLE = ("vasp", "mixer", "sanctioned", "infrastructure", "bridge")
PACK = (
    "struct<source:string,method:string,source_date:string,license:string,default_confidence:double,"
    "labels:array<struct<chain:string,address:string,entity:string,category:string,role:string,confidence:double>>>"
)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of every file below ``path``, as text."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("content").cast("string").alias("content"))


def newest_drops(documents: DataFrame) -> DataFrame:
    """The newest document of each source from names ``<source>__<YYYY-MM-DD>.<ext>``; ties go to the later name, then path.

    A few sources may hold most documents: what is newest combines before the shuffle. Other names have no source.
    """
    name = F.element_at(F.split("path", "/"), -1)
    found = r"^(.+)__(\d{4}-\d{2}-\d{2})\.([A-Za-z0-9]+)$"
    d = documents.withColumn("name", name).where(F.col("name").rlike(found))
    d = d.withColumn("source", F.regexp_extract("name", found, 1)).withColumn("dropped_on", F.regexp_extract("name", found, 2).try_cast("date")).withColumn("media", F.lower(F.regexp_extract("name", found, 3)))
    d = d.where("dropped_on is not null")
    newest = d.groupBy("source").agg(F.max_by(F.struct(*d.columns), F.struct("dropped_on", "name", "path")).alias("x"))
    return newest.select("x.*")


PARSERS = {"json": "pack", "csv": "reserves", "xml": "sanctions", "html": "island", "txt": "list"}


def routed(drops: DataFrame) -> DataFrame:
    """``drops`` with the parser that their media calls for; null has none and is refused."""
    table = F.create_map(*[F.lit(x) for kv in PARSERS.items() for x in kv])
    return drops.withColumn("parser", F.element_at(table, F.col("media")))


def _refusals(docs: DataFrame, rules: dict[str, Column]) -> DataFrame:
    return docs.withColumn("reasons", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()])))


def labelpacks(documents: DataFrame, specs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Claims and refused documents of label packs; ``specs`` (source, method) must agree where given.

    Without source or date, or with a confidence outside (0, 1), a document is refused whole.
    Unknown roles become ``unknown``; categories no rule acts on are kept.
    """
    d = documents.withColumn("p", F.from_json("content", PACK))
    # no lambda reads ``p``: Spark would parse the text again for every claim of it
    own, given = F.col("p.labels.confidence"), F.col("p.default_confidence")
    out = lambda c: (c <= 0) | (c >= 1)
    bad = F.exists(own, out) | (F.exists(own, lambda c: c.isNull()) & (given.isNull() | out(given)))
    rules = {"unreadable": F.col("p").isNull() | F.col("p.labels").isNull(), "source": F.col("p.source").isNull(), "date": F.col("p.source_date").try_cast("date").isNull(), "confidence": F.coalesce(bad, F.lit(False))}
    if specs is not None:
        s = specs.select(F.col("source").alias("_s"), F.col("method").alias("_m")).distinct()
        d = d.join(s, F.col("p.source") == F.col("_s"), "left")
        rules["spec"] = F.col("_s").isNull() | (F.col("_m") != F.col("p.method"))
    d = _refusals(d, rules)
    told = ["p.method", "p.source", "p.source_date", "p.default_confidence"]
    rows = d.where("size(reasons) = 0").select("path", *told, F.explode("p.labels").alias("l"))
    role = F.when(F.col("l.role").isin(*ROLES), F.col("l.role")).otherwise("unknown")
    claims = rows.select("path", "l.chain", "l.address", "l.entity", "l.category", role.alias("role"), F.coalesce("l.confidence", "default_confidence").alias("confidence"), F.coalesce("method", F.lit("unknown")).alias("method"), "source", F.col("source_date").cast("date").alias("source_date"))
    return claims, d.where("size(reasons) > 0").select("path", "reasons")


def inert(claims: DataFrame) -> DataFrame:
    """Claims of categories no rule acts on, counted."""
    return claims.where(~F.col("category").isin(*ACTIONABLE)).groupBy("category").agg(F.count("*").alias("n"))


# Fixed value: ledgers of the network column of reserve tables.
NETWORKS = {
    "ETH": "ethereum", "ETHEREUM": "ethereum", "POLYGON": "polygon", "MATIC": "polygon", "TRON": "tron", "TRX": "tron",
    "BTC": "bitcoin", "BITCOIN": "bitcoin", "SOL": "solana", "SOLANA": "solana",
}


#: A cell of a CSV line: quoted, with doubled quotes and line ends inside, or plain.
_CELL = r'(?:"(?:[^"]++|"")*+"?+[^,\n]*+|[^,\n]*+)'


def reserves(documents: DataFrame, entity: str, source: str, source_date: str) -> tuple[DataFrame, DataFrame]:
    """Claims of reserve tables whose header follows a summary block; and counts by document.

    The header is the first line that names both an address and a message; what follows it is CSV, whose quoted cells
    may hold commas, line ends and doubled quotes; of columns with one name the last counts. Rows with an empty
    address or a network that is not supported are dropped and counted; a document without header or claim, an empty
    and a null one are refused.
    """
    lines = F.split(F.regexp_replace("content", "^\ufeff|\r(?=\n)", ""), "[\n\r]")
    is_header = F.transform("lines", lambda x: F.lower(x).contains("address") & F.lower(x).contains("message"))
    d = documents.select("path", lines.alias("lines")).withColumn("at", F.array_position(is_header, F.lit(True)).cast("int"))
    table_text = F.array_join(F.slice("lines", F.col("at"), F.size("lines")), "\n")
    records = F.regexp_extract_all(table_text, F.lit(f"(?md)^{_CELL}(?:,{_CELL})*+$"), F.lit(0))
    cells = lambda r: F.transform(F.regexp_extract_all(F.concat(F.lit(","), r), F.lit(f",{_CELL}"), F.lit(0)), lambda c: F.trim(_cell(c)))
    d = d.where("at > 0").select("path", F.filter(records, lambda r: r != "").alias("records"))
    # names are read before rows are taken apart: what is told beside a generator is told for every row, from the whole table
    d = d.select("path", "records", F.reverse(F.transform(cells(F.get("records", F.lit(0))), F.lower)).alias("names"))
    d = d.select("path", "names", F.explode(F.slice("records", F.lit(2), F.greatest(F.size("records"), F.lit(1)))).alias("r"))
    d = d.withColumn("cells", cells(F.col("r")))
    at = lambda c: F.when(F.array_contains("names", c), F.get("cells", F.size("names") - F.array_position("names", F.lit(c)).cast("int")))
    rows = d.select("path", F.upper(at("network")).alias("network"), F.nullif(at("address"), F.lit("")).alias("address"))
    table = F.create_map(*[F.lit(x) for kv in NETWORKS.items() for x in kv])
    rows = rows.withColumn("chain", F.element_at(table, F.col("network")))
    good = rows.where("address is not null and chain is not null")
    claims = good.select("path", "chain", "address", F.lit(entity).alias("entity"), F.lit("vasp").alias("category"), F.lit("cold").alias("role"), F.lit(0.95).alias("confidence"), F.lit("proof").alias("method"), F.lit(source).alias("source"), F.lit(source_date).cast("date").alias("source_date")).distinct()
    counts = documents.select("path").join(rows.groupBy("path").agg(F.count_if(F.col("address").isNull()).alias("empty"), F.count_if(F.col("address").isNotNull() & F.col("chain").isNull()).alias("unsupported"), F.count_if(F.col("address").isNotNull() & F.col("chain").isNotNull()).alias("kept")), "path", "left").na.fill(0)
    return claims, counts.withColumn("refused", F.col("kept") == 0)


def _cell(c: Column) -> Column:
    """The value of a cell with the comma before it: its quotes off, doubled ones halved."""
    bare = F.substring(c, 2, 1 << 30)
    inner = F.regexp_replace(F.regexp_extract(bare, r'(?s)^"((?:[^"]++|"")*+)', 1), '""', '"')
    return F.when(bare.startswith('"'), F.concat(inner, F.regexp_extract(bare, r'(?s)^"(?:[^"]++|"")*+"(.*)$', 1))).otherwise(bare)


# Fixed value: ledgers of the currency codes of sanctions lists.
TICKERS = {"XBT": "bitcoin", "BTC": "bitcoin", "ETH": "ethereum", "TRX": "tron", "SOL": "solana"}
TOKEN_TICKERS = ("USDT", "USDC")
# Addresses whose own encoding tells their ledger; other shapes tell none.
ENCODINGS = {
    "ethereum": r"^0x[0-9a-fA-F]{40}$",
    "tron": r"^T[1-9A-HJ-NP-Za-km-z]{33}$",
    "bitcoin": r"^([13][a-km-zA-HJ-NP-Z1-9]{25,34}|(bc1|BC1)[a-zA-Z0-9]{11,71})$",
}
# Fixed value: how a sanctions list writes the code of an address.
CODE = r"(?i)^Digital Currency Address\s*-\s*([A-Za-z0-9]+)$"
_SDN = (
    "struct<publshInformation:array<struct<Publish_Date:string>>,Publish_Date:string,sdnEntry:array<struct<firstName:string,lastName:string,"
    "programList:struct<program:array<string>>,idList:struct<id:array<struct<idType:string,idNumber:string>>>>>,_malformed:string>"
)


def _sdn_rows(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with published and reasons; rows path, published, n, k, entity, ticker, address, chain, refiled) of sanctions XML."""
    told = documents.withColumn("x", F.from_xml("content", _SDN, {"columnNameOfCorruptRecord": "_malformed", "ignoreNamespace": "true"}))
    days = F.filter(F.transform("x.publshInformation", lambda p: F.trim(p["Publish_Date"])), lambda t: t != "")
    day = F.coalesce(F.get(days, F.size(days) - 1), F.trim("x.Publish_Date"))
    text = F.coalesce("content", F.lit(""))
    rooted = text.rlike(r"^\ufeff?\s*(?:<[?!][^>]*>\s*)*<(?:[\w.-]+:)?sdnList[\s>/]")
    closed = text.rlike(r"</(?:[\w.-]+:)?sdnList\s*>\s*(?:<!--[^>]*-->\s*)*\z")
    d = told.withColumn("published", F.coalesce(F.try_to_timestamp(day, F.lit("M/d/yyyy")), F.try_to_timestamp(day, F.lit("yyyy-M-d"))).cast("date"))
    bad = F.col("x").isNull() | F.col("x._malformed").isNotNull()
    d = _refusals(d, {"root": ~rooted, "open": rooted & ~closed, "malformed": rooted & closed & bad, "date": rooted & closed & ~bad & F.col("published").isNull()})
    e = d.where("size(reasons) = 0").select("path", "published", F.posexplode("x.sdnEntry").alias("n", "e"))
    person = F.concat_ws(" ", F.nullif(F.trim("e.firstName"), F.lit("")), F.nullif(F.trim("e.lastName"), F.lit("")))
    programs = F.array_join(F.filter(F.transform("e.programList.program", lambda t: F.trim(t)), lambda t: t != ""), ", ")
    name = F.when(F.length(programs) > 0, F.concat(person, F.lit(" ("), programs, F.lit(")"))).otherwise(person)
    ids = e.where(F.length(person) > 0).select("path", "published", "n", name.alias("entity"), F.posexplode("e.idList.id").alias("k", "i"))
    rows = ids.withColumn("ticker", F.upper(F.regexp_extract(F.trim("i.idType"), CODE, 1))).where("ticker <> ''").withColumn("address", F.trim("i.idNumber")).where("address <> ''")
    ledger = F.element_at(F.create_map(*[F.lit(x) for kv in TICKERS.items() for x in kv]), F.col("ticker"))
    seen = F.coalesce(*[F.when(F.col("address").rlike(shape), F.lit(chain)) for chain, shape in ENCODINGS.items()])
    rows = rows.withColumn("told", ledger).withColumn("seen", seen)
    stands = F.col("seen").isNull() | ((F.col("told") == "solana") & (F.col("seen") == "bitcoin"))
    chain = F.when(F.col("told").isNotNull(), F.when(stands, F.col("told")).otherwise(F.col("seen"))).when(F.col("ticker").isin(*TOKEN_TICKERS), F.col("seen"))
    rows = rows.withColumn("chain", chain)
    return d, rows.withColumn("refiled", F.coalesce(F.col("told") != F.col("chain"), F.lit(False)))


def sanctions(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claims of sanctions XML and refused documents.

    A document is parsed to its end before it gives a claim; names count without their namespace,
    attributes are passed over. Refused whole, with a reason: another root (``root``; so null and
    empty ones), a root that is not closed at the end (``open``), other errors of form
    (``malformed``), no publish date or one of unknown form (``date``), and no claim at all
    (``empty``). The ledger follows the currency code unless the address's own encoding contradicts
    it: then the encoding wins, and the entity says so. Solana addresses have no encoding of their
    own, so a token code on one gives no claim, and a Solana code on a Bitcoin shape stands.
    :func:`skipped_codes` counts what gives none. The first claim of an address in a document wins.
    """
    d, rows = _sdn_rows(documents)
    note = F.concat(F.lit(" (listed by OFAC as "), "ticker", F.lit("; filed on "), "chain", F.lit(" from the address encoding)"))
    rows = rows.where("chain is not null").withColumn("entity", F.when(F.col("refiled"), F.concat("entity", note)).otherwise(F.col("entity")))
    canon = F.when(F.col("address").rlike("^0[xX]"), F.lower("address")).otherwise(F.col("address"))
    w = Window.partitionBy("path", "chain", "address").orderBy("n", "k")
    first = rows.withColumn("address", canon).withColumn("_r", F.row_number().over(w)).where("_r = 1")
    claims = first.select("path", "chain", "address", "entity", F.lit("sanctioned").alias("category"), F.lit("unknown").alias("role"), F.lit(0.99).alias("confidence"), F.lit("official").alias("method"), F.lit("sanctions").alias("source"), F.col("published").alias("source_date"))
    silent = d.where("size(reasons) = 0").select("path").join(rows.select("path"), "path", "left_anti").select("path", F.array(F.lit("empty")).alias("reasons"))
    return claims, d.where("size(reasons) > 0").select("path", "reasons").unionByName(silent)


def skipped_codes(documents: DataFrame) -> DataFrame:
    """(path, ticker, n): addresses of accepted sanctions XML that give no claim: an unknown code, or a token code on a shape that tells no ledger."""
    _, rows = _sdn_rows(documents)
    return rows.where("chain is null").groupBy("path", "ticker").agg(F.count("*").alias("n"))


def address_files(documents: DataFrame) -> DataFrame:
    """Claims of vendored lists, JSON arrays named ``<anything>_<CODE>.json``; an address of several files counts once.

    Files whose code names no ledger give no claims.
    """
    table = F.create_map(*[F.lit(x) for kv in TICKERS.items() for x in kv])
    code = F.upper(F.regexp_extract("path", r"_([A-Za-z]+)\.json$", 1))
    rows = documents.withColumn("chain", F.element_at(table, code)).where("chain is not null").select("chain", F.explode(F.from_json("content", "array<string>")).alias("a"))
    canon = F.when(F.col("a").rlike("^0[xX]"), F.lower("a")).otherwise(F.trim("a"))
    return rows.where("a is not null").select("chain", canon.alias("address"), F.lit("sanctioned").alias("category")).distinct()


def page_island(pages: DataFrame, script_id: str, field: str, html: str = "html", key: str = "page_id") -> DataFrame:
    """(key, record, value): records of a JSON map inside a JSON string inside a script element."""
    pattern = f'(?s)<script[^>]*id="{script_id}"[^>]*>(.*?)</script>'
    outer = F.from_json(F.regexp_extract(F.col(html), pattern, 1), f"struct<{field}:string>")
    return pages.select(key, F.explode(F.from_json(outer[field], "struct<recordMap:map<string,string>>")["recordMap"]).alias("record", "value"))


_RESERVE = "struct<__typename:string,address:string,network:string,lastUpdatedAt:string,balance:struct<__ref:string>>"


def reserve_island(pages: DataFrame, entity: str, source: str, html: str = "html", key: str = "page_id") -> DataFrame:
    """Claims of a reserves page: address records follow their balance's reference to a network.

    The date of a page is that of its oldest record.
    """
    rec = page_island(pages, "server-app-state", "relayStoreData", html, key).withColumn("v", F.from_json("value", _RESERVE))
    own = rec.where("v.__typename = 'ReserveAddress'").select(key, "v.address", F.col("v.balance.__ref").alias("ref"))
    net = rec.select(key, F.col("record").alias("ref"), "v.network")
    day = rec.where("v.lastUpdatedAt is not null").groupBy(key).agg(F.min(F.to_date(F.substring("v.lastUpdatedAt", 1, 10))).alias("source_date"))
    out = own.join(net, [key, "ref"]).join(day, key, "left").where("address is not null and network is not null")
    return out.select(key, F.lower("network").alias("chain"), "address", F.lit(entity).alias("entity"), F.lit("vasp").alias("category"), F.lit("cold").alias("role"), F.lit(source).alias("source"), "source_date").distinct()


def scripts(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """(key, n_scripts, n_with_id, chars): script elements of each page."""
    got = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(r"(?s)<script[^>]*>(.*?)</script>"), F.lit(0))
    ids = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(r'<script[^>]*\sid="'), F.lit(0))
    return pages.select(key, F.size(got).alias("n_scripts"), F.size(ids).alias("n_with_id"), F.aggregate(got, F.lit(0), lambda a, x: a + F.length(x)).alias("chars"))


# Words of tags that name a harm, words and slugs of contracts without custody, the mark of deposits.
HARM = r"(?i)\b(exploiter|hacker|hack|drainer|scam|phish|fake|victim|attacker)\b"
PLUMBING = r"(?i)\b(router|settlement|aggregator|proxy|relayer|vault|pool)\b"
PLUMBING_SLUGS = (
    "dex", "mev-protection", "cow-protocol", "sushiswap", "uniswap", "curve", "balancer", "1inch", "0x-protocol", "paraswap", "aave", "compound",
    "lido", "maker", "bridge", "defi", "yearn", "convex", "pancakeswap", "dydx", "synthetix", "oracle", "nft-marketplace",
)
DEPOSIT = r"(?i)\bdep\b\s*:"
POOL = r"(?i)\bpool\b"


def tag_claims(tags: DataFrame, exchanges: DataFrame) -> DataFrame:
    """Claims of a public tag list (address, tag, n, optional slug): exchange prefixes to entities, plumbing by name or slug.

    An exchange's tag of harm names no exchange; plumbing keeps its own first tag, whatever it says, and one without
    a tag is a ``non-custodial contract``. The first tag of each kind wins. An address that is both is ``vasp`` when
    its plumbing tag has the word pool, since exchanges run pools that take funds in; else it is infrastructure, and
    then of no role. ``exchanges`` (prefix, entity): tags meet them by equal text of each length that a prefix has.
    """
    tags = tags.withColumn("tag", F.trim(F.coalesce("tag", F.lit(""))))
    clean = tags.where((F.col("tag") != "") & ~F.col("tag").rlike(HARM))
    lengths = [r[0] for r in exchanges.select(F.length("prefix").alias("n")).where("n > 0").distinct().orderBy("n").collect()]
    low = F.lower(F.trim("tag"))
    starts = F.array(*[F.when(F.length(low) >= n, F.substring(low, 1, n)) for n in lengths]) if lengths else F.array().cast("array<string>")
    hit = clean.withColumn("_start", F.explode(F.array_compact(starts))).join(exchanges.withColumn("_start", F.lower("prefix")), "_start").drop("_start")
    longest = Window.partitionBy("address").orderBy("n", F.desc(F.length("prefix")), "tag")
    named = hit.withColumn("_r", F.row_number().over(longest)).where("_r = 1").select("address", "entity", F.col("tag").alias("named_tag"))
    slug = F.coalesce(F.trim("slug").isin(*PLUMBING_SLUGS), F.lit(False)) if "slug" in tags.columns else F.lit(False)
    plumb = F.when(F.col("tag") == "", "non-custodial contract").otherwise(F.col("tag"))
    first = tags.where(F.col("tag").rlike(PLUMBING) | slug).groupBy("address").agg(F.min_by(plumb, F.struct("n", "tag")).alias("plumb_tag"))
    out = named.join(first, "address", "full")
    contested = F.col("named_tag").isNotNull() & F.col("plumb_tag").isNotNull()
    vasp = F.col("named_tag").isNotNull() & (~contested | F.col("plumb_tag").rlike(POOL))
    return out.select("address", F.when(vasp, F.col("entity")).otherwise(F.col("plumb_tag")).alias("entity"), F.when(vasp, "vasp").otherwise("infrastructure").alias("category"), F.when(vasp & F.col("named_tag").rlike(DEPOSIT), "deposit").otherwise("unknown").alias("role"))


def listed(documents: DataFrame, chain: str) -> DataFrame:
    """Addresses of text lists: comments off, first place kept, and whether the shape fits the ledger."""
    lines = documents.select("path", F.posexplode(F.split("content", "\r?\n")).alias("n", "line"))
    rows = lines.withColumn("address", F.trim(F.regexp_replace("line", "#.*$", ""))).where("address <> ''")
    first = rows.groupBy("path", "address").agg(F.min("n").alias("place"))
    return first.withColumn("fits", F.array_contains(families(F.col("address")), chain))


def explorer_claims(tags: DataFrame) -> DataFrame:
    """Pending community claims from explorer tags, white space collapsed, confidence 0.30."""
    entity = F.trim(F.regexp_replace("tag", r"\s+", " "))
    return tags.where(F.length(entity) > 0).select("chain", "address", entity.alias("entity"), F.lit("vasp").alias("category"), F.lit("unknown").alias("role"), F.lit(0.30).alias("confidence"), F.lit("community").alias("method"), F.lit("explorer").alias("source"), F.lit("pending").alias("status"))


def metadata_errors(metadata: DataFrame) -> DataFrame:
    """Metadata rows with what is wrong: a null without a note, or a stem that occurs twice."""
    from ..operators.knowledge import entity_stem

    m = metadata.withColumn("stem", entity_stem(F.col("entity"))).withColumn("_n", F.count("*").over(Window.partitionBy("stem")))
    blank = (F.col("jurisdiction").isNull() | F.col("legal_entity").isNull()) & F.col("notes").isNull()
    return _refusals(m, {"duplicate": F.col("_n") > 1, "note": blank, "stem": F.col("stem") == ""}).drop("_n")
