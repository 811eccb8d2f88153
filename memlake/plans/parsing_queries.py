"""Queries over what models are given and give back: prompts, answers, lists, JSON, templates, blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from memlake.functions import text as X
from memlake.plans.catalog import query
from memlake.plans.pipelines import merged_first_lines
from memlake.plans.text_queries import _TURNS, _turns
from memlake.sources.tables import table, texts

_SQUEEZE = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
_ITEM = _SQUEEZE.format(r"regexp_replace(regexp_replace({0}, '\([^()]*\)', '', 'g'), '^(?:\d+[.)、]?\s*[-—–]?\s*)?', '')")


@query(r"""
    SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN text ELSE trim(regexp_replace(text, '^\s+', '')) END AS question FROM conversations""")
def retrieval_questions(spark: SparkSession, d: str) -> DataFrame:
    """Messages behind the two markers of a prompt, and prompts without one."""
    t = table(spark, d, "conversations")
    prompt = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Memory:\n a\nNow Answer the Question: "), "text")).when(F.col("turn") % 3 == 1, F.concat(F.lit("Here is the conversation:\n"), "text")).otherwise(F.col("text"))
    return t.select("conv_id", "turn", X.retrieval_query(prompt).alias("question"))


@query(r"""
    SELECT doc_id, CASE WHEN contains(text, ' ') THEN trim(string_split(regexp_replace(text, '^.* BEGIN ', '', 's'), ' END')[1]) END AS section
    FROM (SELECT doc_id, 'x BEGIN ' || source || ' y BEGIN ' || lang || ' z END of ' || source || ' END' AS text FROM documents)""")
def event_sections(spark: SparkSession, d: str) -> DataFrame:
    """What stands between the last start marker and the first end marker behind it."""
    marked = F.concat(F.lit("x BEGIN "), "source", F.lit(" y BEGIN "), "lang", F.lit(" z END of "), "source", F.lit(" END"))
    return table(spark, d, "documents").select("doc_id", X.event_section(marked, " BEGIN ", [" END", " NEVER"]).alias("section"))


@query(rf"""
    WITH r AS (SELECT p_partkey, 'shop/' || p_brand || '/' || translate(p_name, ' ', '_') || '->(' || p_type || ') ' || p_size AS path, p_size || '. - ' || p_name || ' (' || p_brand || ')  x' AS item FROM part)
    SELECT p_partkey, {_SQUEEZE.format(r"regexp_replace(translate(list_last(string_split(path, '/')), '_->', '   '), '\([^()]*\)', '', 'g')")} AS title, {_ITEM.format("item")} AS item FROM r""")
def cleaned_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles from paths, and items from numbered lists."""
    size = F.col("p_size").cast("string")
    path = F.concat(F.lit("shop/"), "p_brand", F.lit("/"), F.translate("p_name", " ", "_"), F.lit("->("), "p_type", F.lit(") "), size)
    item = F.concat(size, F.lit(". - "), "p_name", F.lit(" ("), "p_brand", F.lit(")  x"))
    return table(spark, d, "part").select("p_partkey", X.clean_title(path).alias("title"), X.clean_item(item).alias("item"))


@query(rf"""
    WITH o AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'You may like 1. ' || p_name || chr(10) || '2) ' || p_brand || ' (new)' || chr(10) || '3.- ' || p_type ELSE p_name || ', ' || p_type || ' (old),' || p_brand END AS output FROM part),
    b AS (SELECT p_partkey, string_split(CASE WHEN strpos(output, '1.') > 0 THEN substr(output, strpos(output, '1.') + 2) ELSE replace(output, ',', chr(10)) END, chr(10)) AS xs FROM o),
    u AS (SELECT p_partkey, unnest(xs) AS x, unnest(range(len(xs))) AS pos FROM b)
    SELECT p_partkey, CAST(pos AS INT) AS pos, {_ITEM.format("trim(x)")} AS item FROM u""")
def recommended_items(spark: SparkSession, d: str) -> DataFrame:
    """Items of numbered lists, and of comma lists where there is no ``1.``."""
    numbered = F.concat(F.lit("You may like 1. "), "p_name", F.lit("\n2) "), "p_brand", F.lit(" (new)\n3.- "), "p_type")
    output = F.when(F.col("p_size") % 2 == 0, numbered).otherwise(F.concat("p_name", F.lit(", "), "p_type", F.lit(" (old),"), "p_brand"))
    return table(spark, d, "part").select("p_partkey", F.posexplode(X.recommendation_items(output)).alias("pos", "item"))


@query(r"""SELECT event_id, '{"n": ' || event_id || '}' AS last, props AS fenced FROM events""")
def json_answers(spark: SparkSession, d: str) -> DataFrame:
    """The last object of an answer, and the body of a fenced one."""
    last = F.concat(F.lit("First {"), "event_type", F.lit(": 0} then "), F.lit('{"n": '), F.col("event_id").cast("string"), F.lit("} done"))
    return table(spark, d, "events").select("event_id", X.last_json_object(last).alias("last"), X.strip_code_fence(F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).alias("fenced"))


@query("""SELECT s_suppkey, e AS entity, s_name AS s, 'based_in' AS p, n_name AS o FROM supplier JOIN nation ON s_nationkey = n_nationkey, (SELECT unnest([1, 2]) AS k)
    , LATERAL (SELECT CASE WHEN k = 1 THEN s_name ELSE n_name END AS e)""")
def json_triples(spark: SparkSession, d: str) -> DataFrame:
    """Named entities and triples of fenced JSON answers; a list that is no triple, and a repeat, are dropped."""
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    j = s.join(n, s.s_nationkey == n.n_nationkey)
    names = F.to_json(F.struct(F.array("s_name", "n_name").alias("named_entities")))
    one = F.array("s_name", F.lit("based_in"), "n_name")
    triples = F.to_json(F.struct(F.array(one, F.array("s_name"), one).alias("triples")))
    rows = j.select("s_suppkey", X.named_entities(F.concat(F.lit("```json\n"), names, F.lit("\n```"))).alias("es"), X.triples(triples).alias("ts"))
    return rows.select("s_suppkey", F.explode("es").alias("entity"), "ts").select("s_suppkey", "entity", F.explode("ts").alias("t")).select("s_suppkey", "entity", "t.*")


@query("SELECT n_nationkey, n_name AS fact, r_name || chr(10) || 'two' AS fact_after_filter, '' AS missing FROM nation JOIN region ON n_regionkey = r_regionkey")
def prompt_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections of an answer by their headers."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    answer = F.concat(F.lit("[[ ## fact ## ]]\n"), "n_name", F.lit("\n\n[[ ## fact_after_filter ## ]]\n"), "r_name", F.lit("\ntwo\n\n[[ ## completed ## ]]"))
    return n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", X.section(answer, "fact").alias("fact"), X.section(answer, "fact_after_filter").alias("fact_after_filter"), X.section(answer, "nothing").alias("missing"))


@query("""
    SELECT conv_id, turn, 'system: Be brief.' || chr(10) || 'user: ' || text AS chat, role || ' -- says -- ' || conv_id || chr(10) || 'x -- in -- ' || role AS relations,
           '# FACTS' || chr(10) || '- ' || role || chr(10) || '- b' || chr(10) || chr(10) || '# ENTITIES' || chr(10) || '- c' || conv_id || chr(10) || chr(10) || '# EPISODES' || chr(10) AS context,
           'Turn ' || turn || ' of {nobody}: ' || role || ' ' || role AS filled
    FROM conversations""")
def composed_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Chats, relations, search results and templates as texts; a template's unknown keys stay."""
    conv = F.col("conv_id").cast("string")
    rel = lambda a, b, c: F.struct(a.alias("source"), b.alias("relationship"), c.alias("destination"))
    return table(spark, d, "conversations").select(
        "conv_id",
        "turn",
        X.messages_text(X.chat(F.lit("Be brief."), F.col("text"))).alias("chat"),
        X.relation_lines(F.array(rel(F.col("role"), F.lit("says"), conv), rel(F.lit("x"), F.lit("in"), F.col("role")))).alias("relations"),
        X.search_context(F.array("role", F.lit("b")), F.array(F.concat(F.lit("c"), conv)), F.array().cast("array<string>")).alias("context"),
        X.fill_template("Turn {turn} of {nobody}: {who} {who}", {"turn": F.col("turn"), "who": F.col("role")}).alias("filled"),
    )


@query("""SELECT o_orderkey, coalesce(strftime(CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END, '%Y-%m-%d %H:%M:%S'), 'date unknown') || ' - ' || coalesce(strftime(CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 30 DAY END, '%Y-%m-%d %H:%M:%S'), 'present') AS valid FROM orders""")
def edge_date_ranges(spark: SparkSession, d: str) -> DataFrame:
    """When a fact holds; open at an end that is not known."""
    at = F.col("o_orderdate").cast("timestamp")
    return table(spark, d, "orders").select("o_orderkey", X.edge_date_range(F.when(F.col("o_orderstatus") != "P", at), F.when(F.col("o_orderstatus") == "F", at + F.expr("INTERVAL 30 DAYS"))).alias("valid"))


_WS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')"


@query(rf"""SELECT doc_id, substr(text, 1, 50) AS first, array_to_string({_WS}[1:20], ' ') AS head, array_to_string({_WS}[-20:], ' ') AS tail, replace('a' || chr(9) || lang, chr(9), ' ') AS spaced FROM documents""")
def cut_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts cut by characters and by words at either end, and without tabs."""
    return texts(spark, d, "documents").select("doc_id", X.first_chars("text", 50).alias("first"), X.keep_head("text", 20).alias("head"), X.keep_tail("text", 20).alias("tail"), X.tabs_to_spaces(F.concat(F.lit("a\t"), "lang")).alias("spaced"))


_BARE = r"list_filter(list_transform(regexp_split_to_array(lower({0}), '\s+'), lambda w: regexp_replace(w, '\W', '', 'g')), lambda w: w <> '')"


@query(f"""
    WITH w AS (SELECT conv_id, turn, lower(trim(text)) = lower(trim(gold)) AS same, {_BARE.format('text')} AS pw, {_BARE.format('gold')} AS gw FROM ({_TURNS}) WHERE gold IS NOT NULL),
    a AS (SELECT conv_id, turn, x, count(*) AS c FROM (SELECT conv_id, turn, unnest(pw) AS x FROM w) GROUP BY ALL),
    b AS (SELECT conv_id, turn, x, count(*) AS c FROM (SELECT conv_id, turn, unnest(gw) AS x FROM w) GROUP BY ALL),
    o AS (SELECT conv_id, turn, sum(least(a.c, b.c)) AS n FROM a JOIN b USING (conv_id, turn, x) GROUP BY ALL)
    SELECT conv_id, turn, same, round(CASE WHEN len(pw) = 0 AND len(gw) = 0 THEN 1.0 WHEN coalesce(n, 0) = 0 THEN 0.0 ELSE 2.0 * n / (len(pw) + len(gw)) END, 6) AS f1 FROM w LEFT JOIN o USING (conv_id, turn)""")
def word_scores(spark: SparkSession, d: str) -> DataFrame:
    """Trimmed equality and F1 over bare words."""
    return _turns(spark, d).select("conv_id", "turn", X.exact_match_trimmed("text", "gold").alias("same"), F.round(X.token_f1_words("text", "gold"), 6).alias("f1"))


@query(r"""
    WITH l AS (SELECT p_partkey, lower(trim(p_name || 's')) AS c FROM part)
    SELECT p_partkey, CASE WHEN regexp_matches(c, '[^aeiou]ies$') THEN regexp_replace(c, 'ies$', 'y') WHEN regexp_matches(c, '(ss|sh|ch|x|z)es$') THEN regexp_replace(c, 'es$', '')
        WHEN regexp_matches(c, '[^sui]s$') THEN regexp_replace(c, 's$', '') ELSE c END AS concept FROM l""")
def concepts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", X.concept(F.concat("p_name", F.lit("s"))).alias("concept"))


@query("""
    WITH l AS (SELECT conv_id, turn, role || chr(10) || turn || ': ' || substr(text, 1, 20) AS t FROM conversations), s AS (SELECT conv_id, turn, string_split(t, chr(10))[1] AS head, substr(t, strpos(t, chr(10)) + 1) AS body FROM l)
    SELECT conv_id, head || chr(10) || string_agg(body, chr(10) ORDER BY turn) AS text FROM s GROUP BY conv_id, head""")
def merged_passages(spark: SparkSession, d: str) -> DataFrame:
    """Passages of a conversation with the same first line become one."""
    t = table(spark, d, "conversations").select("conv_id", "turn", F.concat("role", F.lit("\n"), F.col("turn").cast("string"), F.lit(": "), F.substring("text", 1, 20)).alias("text"))
    return merged_first_lines(t, "conv_id", "turn")


@query("""
    SELECT c_custkey, 'Name: ' || c_name || chr(10) || 'Segment: ' || c_mktsegment || chr(10) || 'new' AS appended, 'Name: X' || chr(10) || 'Segment: ' || c_mktsegment AS replaced,
           'Name: ' || c_name || chr(10) || 'mid' || chr(10) || 'Segment: ' || c_mktsegment AS inserted, 'Name: ' || c_name || chr(10) || 'Segment: ' || c_mktsegment || chr(10) || 'end' AS last FROM customer""")
def block_edits(spark: SparkSession, d: str) -> DataFrame:
    """A core memory block appended to, replaced in, and inserted into."""
    c = table(spark, d, "customer").withColumn("block", F.concat(F.lit("Name: "), "c_name", F.lit("\nSegment: "), "c_mktsegment"))
    return c.select("c_custkey", X.block_append("block", F.lit("new")).alias("appended"), X.block_replace("block", F.col("c_name"), F.lit("X")).alias("replaced"), X.block_insert("block", 1, F.lit("mid")).alias("inserted"), X.block_insert("block", -1, F.lit("end")).alias("last"))


@query("SELECT conv_id, turn, CASE WHEN role = 'user' THEN 1 ELSE 0 END AS listed, CASE WHEN role = 'user' THEN text END AS first FROM conversations")
def listed_values(spark: SparkSession, d: str) -> DataFrame:
    """Scalars as lists of one; null and empty ones as empty lists."""
    from memlake.sources.tables import as_list

    one = as_list(F.when(F.col("role") == "user", F.col("text")).when(F.col("role") == "system", ""))
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(one).alias("listed"), F.try_element_at(one, F.lit(1)).alias("first"))
