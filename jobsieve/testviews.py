"""The given tables seen as postings, resumes, applications, messages and events.

Each view matches the SQL view of the same name in ``queries.registry``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .session import prepare


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A parquet table with its zone-less times read as UTC."""
    df = prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    for field in df.schema.fields:
        if field.dataType.typeName() == "timestamp_ntz":
            df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
    if name == "documents":
        df = spread(df, "doc_id")
    return df


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use every core when the files give fewer pieces than there are cores.

    Text work is heavy per row. A large table has many more pieces than cores and is
    left as it is, so nothing large is ever shuffled here.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def _rows(df: DataFrame) -> Column:
    return df.agg(F.count(F.lit(1))).scalar()


def status_of(events: DataFrame) -> DataFrame:
    k = F.regexp_extract("props", '"k": *([0-9]+)', 1).cast("int")
    even = k % 2 == 0
    kind = F.col("event_type")
    status = (
        F.when(kind == "view", "sourced")
        .when(kind == "click", F.when(even, "tailored").otherwise("applied"))
        .when(kind == "signup", F.when(even, "outreach").otherwise("replied"))
        .when(kind == "purchase", F.when(even, "interview").otherwise("offer"))
        .when(kind == "error", "rejected")
    )
    return events.select(
        (F.col("user_id") * 100 + F.floor(F.dayofmonth("ts") / 3)).alias("application_id"),
        F.col("event_id").alias("seq"), F.col("ts").alias("event_at"), status.alias("status"),
    )


def status_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status_of(table(spark, sf_dir, "events"))


def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.funnel import fold_status

    app = F.col("application_id")
    pages, docs = _rows(table(spark, sf_dir, "pages")), _rows(table(spark, sf_dir, "documents"))
    return fold_status(status_events(spark, sf_dir)).select(
        "*",
        (app % pages).alias("job_id"),
        F.when(app % 4 == 0, "strong").when(app % 4 == 1, "possible").when(app % 4 == 2, "reach").alias("fit_tier"),
        F.when(app % 5 != 0, app % docs).alias("version_id"),
        F.when(app % 3 == 0, "api").when(app % 3 == 1, "paste").otherwise("manual").alias("source"),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("job_id"), "url",
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("company"),
        F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("City "), (F.col("page_id") % 7).cast("string"))).alias("location"),
    )


STEP_ORDER = ["sequence_step", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
STEP_BLOCKS = ["sequence_step", "part_block"]


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    shipped = F.col("l_linestatus") == "F"
    return joined.select(
        F.col("l_orderkey").alias("application_id"),
        F.when(F.col("o_custkey") % 6 != 0, F.col("o_custkey")).alias("contact_id"),
        F.col("l_linenumber").alias("sequence_step"),
        F.col("o_orderdate").alias("created_at"),
        (F.col("l_quantity").cast("int") % 7).alias("day_offset"),
        F.when(shipped, F.col("l_shipdate")).alias("sent_at"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1) & shipped, "replied")
        .when(shipped, "sent").otherwise("scheduled").alias("status"),
        "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate",
        F.floor(F.col("l_partkey") / 4096).alias("part_block"),
    )


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "orders").join(
        table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    address = F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("@mail.example"))
    return joined.select(
        F.col("o_orderkey").alias("application_id"), F.col("o_custkey").alias("contact_id"),
        F.col("c_name").alias("name"),
        F.when(F.col("c_custkey") % 5 == 0, F.lit(None).cast("string"))
        .when(F.col("o_orderkey") % 2 == 0, F.upper(address)).otherwise(address).alias("email"),
        F.col("o_orderdate").alias("created_at"),
    )


def outreach_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "orders").where(F.col("o_orderkey") % 10 != 0)
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("o_orderkey").alias("application_id"), F.col("n_name").alias("company"),
            F.col("o_orderpriority").alias("title"),
        )
    )


def _text(c: Column) -> Column:
    return c.cast("string")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    tier = (
        F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "strong")
        .when(F.col("quality") == 1, "possible").when(F.col("quality") == 0, "reach")
    )
    url = F.concat(
        F.lit("https://www.Jobs.example.com/p/"), _text(doc - doc % 5), F.lit("/?utm_source="),
        F.col("source"), F.lit("&id=1"),
    )
    posted = F.timestamp_seconds(F.unix_seconds(F.lit("2024-01-01 00:00:00").cast("timestamp")) + doc * 37 * 60)
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select(
        F.concat(F.lit("doc-"), _text(F.when(doc % 3 == 0, doc - doc % 9).otherwise(doc))).alias("external_id"),
        F.concat(F.lit("Role "), _text(F.floor(doc / 5))).alias("title"),
        F.col("lang").alias("company"), F.col("source").alias("location"),
        F.when(doc % 7 != 0, url).alias("url"),
        F.when(doc % 4 != 0, F.col("text")).alias("description"),
        F.when(doc % 6 != 0, posted).alias("posted_at"),
        (doc % 3 == 0).alias("remote"), "source",
        F.regexp_extract("source", "([0-9]+)", 1).cast("int").alias("adapter_rank"),
        doc.alias("pos"), tier.alias("tier"),
    )


def searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item's whole text and each of its clauses as a search; some name only a place."""
    parts = F.concat(F.array("text"), F.split("text", r"[.!?,\n]"))
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(parts).alias("i", "x"))
    item, i, x = F.col("item_id"), F.col("i"), F.col("x")
    blank = (i == 0) & (item % 11 == 7)
    return rows.where((i == 0) | (F.trim("x") != "")).select(
        (item * 100 + i).alias("query_id"),
        F.when(blank, " ").when(i % 2 == 1, F.concat(F.lit("  "), F.upper(F.left(x, F.lit(2))), F.substr(x, F.lit(3)))).otherwise(x).alias("keywords"),
        F.when((item % 3 == 0) | blank, "SRC1").alias("location"), (item % 4 == 0).alias("remote_only"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "line")
    )


def prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    for was, now in (
        (" the ", " experience with "), (" and ", " results-driven Kafka "),
        (" that ", " Machine  learning, "), (" for ", " leveraging CI/CD "),
    ):
        text = F.replace(text, F.lit(was), F.lit(now))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = spread(table(spark, sf_dir, "conversations"), "conv_id")
    later = talk.select("conv_id", (F.col("turn") - 2).alias("turn"), F.col("text").alias("now"))
    return talk.select("conv_id", "turn", F.col("text").alias("was")).join(later, ["conv_id", "turn"])


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A binary tree of versions per hundred documents."""
    doc = F.col("doc_id")
    hundred = F.floor(doc / 100)
    hours = (doc * 13) % 29
    return table(spark, sf_dir, "documents").select(
        doc.alias("version_id"),
        F.when(doc % 100 != 0, hundred * 100 + F.floor((doc % 100) / 2)).alias("parent_id"),
        hundred.alias("resume_id"),
        F.timestamp_seconds(F.unix_seconds(F.lit("2024-01-01 00:00:00").cast("timestamp")) + hours * 3600).alias("created_at"),
        F.concat(F.col("lang"), F.lit("-"), _text(doc)).alias("label"),
    )


def month_text(year: Column, month: Column, shape: Column) -> Column:
    """A year and month in one of the three spellings resumes use."""
    names = F.array(*[F.lit(m) for m in "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()])
    padded = F.lpad(_text(month), 2, "0")
    return (
        F.when(shape == 0, F.concat(_text(year), F.lit("-"), padded))
        .when(shape == 1, F.concat(F.get(names, month.cast("int") - 1), F.lit(" "), _text(year)))
        .otherwise(F.concat(padded, F.lit("/"), _text(year)))
    )


def resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as resume content: the first line is the summary, each four further lines a job."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text", F.split("text", "\n").alias("ls"))
    doc = F.col("doc_id")
    count = F.ceil((F.size("ls") - 1) / F.lit(4)).cast("int")
    index = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))

    def bullet(b: Column, j: Column) -> Column:
        return (
            F.when((doc + j) % 9 == 0, F.concat(F.lit("My "), b))
            .when((doc + j) % 9 == 1, F.replace(b, F.lit(" the "), F.lit(" seamlessly leveraged ")))
            .otherwise(b)
        )

    def job(e: Column) -> Column:
        shape = F.when(doc % 5 == 0, e % 3).otherwise(0)
        year, month = 2008 + (doc + e) % 12, 1 + (doc + 3 * e) % 12
        end = (
            F.when((e == 0) & (doc % 3 == 0), F.lit(None).cast("string"))
            .when((e == 0) & (doc % 7 == 1), "Present")
            .otherwise(month_text(year + 1, month, shape))
        )
        return F.struct(
            F.concat(F.lit("Company "), _text((doc + e) % 13)).alias("company"),
            F.concat(F.lit("Role "), _text(e % 3)).alias("title"),
            F.lit(None).cast("string").alias("location"),
            month_text(year, month, shape).alias("start"),
            end.alias("end"),
            F.transform(F.slice(F.col("ls"), 2 + 4 * e, 4), bullet).alias("bullets"),
        )

    none = F.lit(None).cast("string")
    empty = F.array().cast("array<string>")
    last_line = F.when(F.size("ls") > 1, F.get("ls", F.size("ls") - 1))
    content = F.struct(
        F.struct(
            F.concat(F.lit("Person "), _text(doc)).alias("name"), F.col("source").alias("label"),
            F.concat(F.lit("p"), _text(doc), F.lit("@example.com")).alias("email"),
            F.lit("+1 555 0100").alias("phone"), none.alias("url"),
            F.col("lang").alias("location"), F.get("ls", 0).alias("summary"),
        ).alias("basics"),
        F.transform(index, job).alias("experience"),
        F.array(
            F.struct(
                F.concat(F.lit("School "), _text(doc % 7)).alias("institution"),
                F.when(doc % 2 == 1, "BSc").alias("degree"), none.alias("location"),
                F.lit("2001").alias("start"),
                F.when(doc % 3 == 0, "June 2005").otherwise("2005-06").alias("end"),
                empty.alias("bullets"),
            )
        ).alias("education"),
        F.array(F.struct(F.lit("Words").alias("category"), F.split(F.get("ls", 0), " ").alias("items"))).alias("skills"),
        F.array(
            F.struct(
                F.concat(F.lit("Project "), _text(doc % 5)).alias("name"), last_line.alias("description"),
                none.alias("url"), empty.alias("bullets"),
            )
        ).alias("projects"),
        F.when(doc % 10 == 0, F.array(F.struct(F.lit("Notes").alias("title"), empty.alias("bullets"))))
        .otherwise(F.array().cast("array<struct<title:string,bullets:array<string>>>")).alias("custom"),
    )
    return docs.select("doc_id", "text", content.alias("content"))


def parsed_resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a lossy reader might hand back: some bullets altered, some schools lost, some unread."""
    doc = F.col("doc_id")

    def altered(e: Column) -> Column:
        bullets = F.transform(
            e["bullets"], lambda b, j: F.when((doc + j) % 6 == 0, F.concat(b, F.lit(" x"))).otherwise(F.replace(b, F.lit(" "), F.lit("  ")))
        )
        return F.struct(e["company"], e["title"], e["location"], e["start"], e["end"], bullets.alias("bullets"))

    content = F.struct(
        F.col("content.basics"),
        F.transform("content.experience", altered).alias("experience"),
        F.when(doc % 11 == 0, F.slice("content.education", 1, 0)).otherwise(F.col("content.education")).alias("education"),
        F.col("content.skills"), F.col("content.projects"), F.col("content.custom"),
    )
    return resumes(spark, sf_dir).where(doc % 17 != 0).select("doc_id", content.alias("content"))
