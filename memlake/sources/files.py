"""Files: folders, text, JSON, CSV, ontologies, multi-hop QA sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from memlake.functions.ids import hash_id, uuid5

#: Which extensions make which kind of document.
KINDS = {
    "text": ["txt", "md", "csv", "json", "xml", "html", "py"],
    "pdf": ["pdf"],
    "audio": ["aac", "mid", "mp3", "m4a", "ogg", "flac", "wav", "amr", "aiff"],
    "image": ["png", "dwg", "xcf", "jpg", "jpx", "apng", "gif", "webp", "cr2", "tif", "bmp", "jxr", "psd", "ico", "heic", "avif"],
    "unstructured": ["doc", "docx", "odt", "xls", "xlsx", "ods", "ppt", "pptx", "odp"],
}


def folder(spark: SparkSession, path: str, extensions: list[str] | None = None, recursive: bool = True) -> DataFrame:
    """``(path, name, extension, size, modified, content)`` of a folder's files in any store."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    out = df.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")
    out = out.withColumn("extension", F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1)))
    return out.where(F.col("extension").isin([e.lstrip(".").lower() for e in extensions])) if extensions else out


def classified(files: DataFrame) -> DataFrame:
    """Files with their ``kind``; an unknown extension fails when read."""
    kind = F.create_map(*[F.lit(x) for k, es in KINDS.items() for e in es for x in (e, k)])
    known = F.element_at(kind, F.col("extension"))
    return files.withColumn("kind", F.when(known.isNotNull(), known).otherwise(F.raise_error(F.concat(F.lit("unknown extension: "), "extension"))))


def ingested(files: DataFrame, owner: str) -> DataFrame:
    """One row per content: ``(data_id, content_hash, name, extension, owner)``; equal contents of an owner share an id."""
    h = F.md5("content")
    return files.select(uuid5(F.concat(h, F.lit(owner))).alias("data_id"), h.alias("content_hash"), "name", "extension", F.lit(owner).alias("owner")).dropDuplicates(["data_id"])


def merged_data(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored rows with new ones taking the place of their ids."""
    return stored.join(new, "data_id", "left_anti").unionByName(new)


def whole_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "text")


#: Bytes of a context file up to which it is joined to its questions.
CONTEXT_BYTES = 64 << 20


def qa_with_context(spark: SparkSession, qa_path: str, context_path: str, schema: str = "question string, answer array<string>", lines: bool = False) -> DataFrame:
    """JSON questions, one list of them or, with ``lines``, one a line, each with the one context file's text, which is one row of a checked size."""
    sizes = spark.read.format("binaryFile").load(context_path).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    if sizes > CONTEXT_BYTES:
        raise ValueError(f"a context of {sizes} bytes is too long to go with every question; cut it into chunks")
    qa = spark.read.schema(schema).json(qa_path, multiLine=not lines)
    return qa.join(F.broadcast(whole_text(spark, context_path).limit(1).withColumnRenamed("text", "context")))


def jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def csv_rows(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    r = spark.read.option("header", "true")
    return (r.schema(schema) if schema else r).csv(path)


def embeddable(passages: DataFrame) -> DataFrame:
    """Passages with a text, the first of equal embeddings."""
    return passages.where(F.length(F.trim("text")) > 0).dropDuplicates(["embedding"])


def extraction_rows(cache: DataFrame) -> DataFrame:
    """Extraction results keyed by their passage's content."""
    return cache.withColumn("idx", hash_id(F.col("passage"), "chunk-")).dropDuplicates(["idx"])


def nested_ontology(rows: DataFrame, levels: int, key: str = "name", kids: str = "children") -> DataFrame:
    """``(parent, child)`` links of nested ``children`` arrays, level by level."""
    out, level = None, rows.select(F.struct("*").alias("n"))
    for _ in range(levels):
        if kids not in level.schema["n"].dataType.names:
            break
        pairs = level.select(F.col(f"n.{key}").alias("parent"), F.explode(f"n.{kids}").alias("n"))
        part = pairs.select("parent", F.col(f"n.{key}").alias("child"))
        out = part if out is None else out.unionByName(part)
        level = pairs.select("n")
    return out


def config_rows(spark: SparkSession, path: str) -> DataFrame:
    """``(file, key, value)`` of flat configuration files: ``key: value`` lines, quotes and comments taken off."""
    lines = spark.read.text(path).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), "value")
    line = r"^([\w.-]+)\s*:\s*(?:\"([^\"]*)\"|'([^']*)'|(.*?))\s*(?:\s#.*)?$"
    part = lambda k: F.regexp_extract("value", line, k)
    return lines.where(F.col("value").rlike(line)).select("file", part(1).alias("key"), F.concat(part(2), part(3), part(4)).alias("value"))


def config(spark: SparkSession, path: str) -> dict[str, str]:
    """One configuration file as a mapping; it is small."""
    return {r["key"]: r["value"] for r in config_rows(spark, path).collect()}


#: The elements of an ontology file that are nodes, and their kind.
NODE_TAGS = {"owl:Class": "classes", "rdfs:Class": "classes", "owl:NamedIndividual": "individuals"}
#: The properties that mean "is a".
IS_A = ("rdfs:subClassOf", "rdf:type")


def rdf_ontology(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(id, name, kind)`` of RDF/XML files' classes and individuals, and their ``(src, rel, dst)`` links.

    Elements are read as rows, so files of any size are parsed by the executors.
    """
    short = lambda c: F.regexp_extract(c, r"([^#/]*)$", 1)
    key = lambda c: F.translate(F.lower(short(c)), " ", "_")
    nodes = spark.createDataFrame([], "id string, name string, kind string")
    links = spark.createDataFrame([], "src string, rel string, dst string")
    for tag, kind in NODE_TAGS.items():
        rows = spark.read.format("xml").option("rowTag", tag).load(path)
        names = [f"`{c}`" for c in ("_rdf:about", "_rdf:ID") if c in rows.columns]
        if not names:
            continue
        rows = rows.withColumn("__iri", F.coalesce(*names)).where("__iri is not null")
        nodes = nodes.unionByName(rows.select(key(F.col("__iri")).alias("id"), short(F.col("__iri")).alias("name"), F.lit(kind).alias("kind")))
        for f in rows.schema:
            many = isinstance(f.dataType, T.ArrayType)
            inner = f.dataType.elementType if many else f.dataType
            if isinstance(inner, T.StructType) and "_rdf:resource" in inner.names:
                to = F.explode(F.col(f"`{f.name}`.`_rdf:resource`")) if many else F.col(f"`{f.name}`.`_rdf:resource`")
                rel = "is_a" if f.name in IS_A else f.name.rpartition(":")[2]
                found = rows.select(key(F.col("__iri")).alias("src"), F.lit(rel).alias("rel"), to.alias("to")).where("to is not null")
                links = links.unionByName(found.select("src", "rel", key(F.col("to")).alias("dst")))
    return nodes, links


def multihop(df: DataFrame, layout: str) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, text)`` corpus and ``(id, question, answer, golden)`` rows of a multi-hop QA set.

    ``titled``: ``context`` is an array of ``(title, sentences)`` and
    ``supporting`` an array of ``(title, sent)``.  ``paragraphs``: paragraphs
    have a title and text, and decomposed questions point to them by position.
    """
    if layout == "titled":
        docs = df.select(F.explode("context").alias("c")).select(F.concat("c.title", F.lit("\n"), F.array_join("c.sentences", "")).alias("text"))
        find = lambda s: F.concat(s["title"], F.lit(": "), F.try_element_at(F.element_at(F.filter("context", lambda c: c["title"] == s["title"]), 1)["sentences"], s["sent"] + 1))
        golden = F.array_join(F.transform("supporting", find), "\n")
    else:
        docs = df.select(F.explode("paragraphs").alias("p")).select(F.concat("p.title", F.lit("\n"), "p.paragraph_text").alias("text"))
        at = lambda i: F.try_element_at("paragraphs", i + 1)
        golden = F.array_join(F.transform("question_decomposition", lambda q: F.concat(at(q["paragraph_support_idx"])["title"], F.lit(": "), at(q["paragraph_support_idx"])["paragraph_text"])), "\n")
    docs = docs.distinct().select(hash_id(F.col("text"), "doc-").alias("doc_id"), "text")
    return docs, df.select("id", "question", "answer", golden.alias("golden"))
