"""Text expressions: normalisation, parsing, cleaning, token scores."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: The ASCII punctuation that answers are compared without.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

#: Words left out of frequent-word titles.
STOP_WORDS = [
    "a", "an", "the", "and", "or", "but", "is", "are", "was", "were", "in", "on", "at", "to", "for", "with",
    "by", "about", "of", "from", "as", "that", "this", "these", "those", "it", "its", "them", "they", "their", "he", "she",
    "his", "her", "him", "we", "our", "you", "your", "not", "be", "been", "being", "have", "has", "had", "do", "does",
    "did", "can", "could", "will", "would", "shall", "should", "may", "might", "must", "when", "where", "which", "who", "whom", "whose",
    "why", "how",
]

#: Typed entity patterns and the text that describes a hit.
ENTITY_PATTERNS = {
    "EMAIL": (r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "Email address: {}"),
    "PHONE": (r"\+?\d{1,4}[\s-]?\(?\d{2,4}\)?[\s-]?\d{3,4}[\s-]?\d{3,4}", "Phone number: {}"),
    "URL": (r"https?:\/\/(www\.)?[a-zA-Z0-9-]+(\.[a-zA-Z]{2,})+(\/\S*)?", "URL: {}"),
    "DATE": (r"(\d{4}[-/]\d{2}[-/]\d{2})|(\d{2}[-/]\d{2}[-/]\d{4})", "Date: {}"),
    "TIME": (r"(1[0-2]|0?[1-9]):[0-5][0-9](\s?[APap][Mm])?|([01]?[0-9]|2[0-3]):[0-5][0-9]", "Time: {}"),
    "MONEY": (r"\$?\d{1,3}(,\d{3})*(\.[0-9]{2})?|\€?\d{1,3}(\.\d{3})*(,[0-9]{2})?", "Monetary amount: {}"),
    "PERSON": (r"\b(?:(?:Dr|Prof|Mr|Mrs|Ms)\.?\s+)?[A-Z][a-z]+(?:\s+(?:[A-Z][a-z]+|[A-Z]\.?|(?:van|de|la|del|von|der|le)))+\b", "Person name: {}"),
    "HASHTAG": (r"\#[A-Za-z0-9_]+", "Hashtag: {}"),
    "MENTION": (r"\@[A-Za-z0-9_]+", "Mention: {}"),
    "IP_ADDRESS": (r"(?<!\d\.)(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]\d?|0)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]\d?|0)(?!\.\d)", "IP address: {}"),
}

#: The same hits as the JVM finds them: its engine takes stack for each repetition of a group
#: that it may step back into.  Here such groups are possessive, and each word of a name ends where
#: a name may end; an initial's point is taken before another word, or where a name ends after it.
POSSESSIVE_PATTERNS = {
    "URL": r"https?:\/\/(www\.)?[a-zA-Z0-9-]+(\.[a-zA-Z]{2,})++(\/\S*)?",
    "PERSON": r"\b(?:(?:Dr|Prof|Mr|Mrs|Ms)\.?\s+)?[A-Z][a-z]+(?:\s+(?:(?:[A-Z][a-z]+|van|de|la|del|von|der|le)\b|[A-Z]\b(?:\.(?=\b|\s+(?:[A-Z][a-z]*|van|de|la|del|von|der|le)\b))?))++",
}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, f) -> Column:
    """``f`` of a value that is computed once: a lambda's body computes what it names from outside each time."""
    return F.element_at(F.transform(F.array(value), f), 1)


def squeeze(c: Column | str) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def normalize_answer(c: Column | str) -> Column:
    """Lower case, no ASCII punctuation, no articles, single spaces.

    Punctuation is deleted, not spaced, and before the articles go.
    """
    bare = F.translate(F.lower(col(c)), PUNCTUATION, "")
    return squeeze(F.regexp_replace(bare, r"(?U)\b(a|an|the)\b", " "))


def words(c: Column | str) -> Column:
    """White-space tokens; none for an empty text."""
    return F.array_remove(F.split(col(c), r"\s+"), "")


def numbered(tokens: Column) -> Column:
    """Tokens in order, each with the number of its occurrence, so equal ones differ."""
    number = lambda t: F.transform(t, lambda x, i: F.concat(x, F.lit(" "), (i + 1 - F.array_position(t, x)).cast("string")))
    return let(F.array_sort(tokens), number)


def overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two token arrays (tokens without spaces)."""
    return F.size(F.array_intersect(numbered(a), numbered(b)))


def _f1(a: Column, b: Column) -> Column:
    """F1 of two bound token arrays."""
    return let(overlap(a, b), lambda c: F.when(c > 0, 2.0 * c / (F.size(a) + F.size(b))).otherwise(F.lit(0.0)))


def _bound(a: Column, b: Column, f) -> Column:
    return let(a, lambda x: let(b, lambda y: f(x, y)))


def token_f1(pred: Column | str, gold: Column | str) -> Column:
    """Token F1 on normalised answers; a yes/no/noanswer that differs scores 0."""

    def score(a: Column, b: Column) -> Column:
        special = (a.isin("yes", "no", "noanswer") | b.isin("yes", "no", "noanswer")) & (a != b)
        return F.when(special, F.lit(0.0)).otherwise(_bound(words(a), words(b), _f1))

    return _bound(normalize_answer(pred), normalize_answer(gold), score)


def token_f1_plain(pred: Column | str, gold: Column | str) -> Column:
    """Token F1 on normalised answers without the yes/no rule."""
    return _bound(words(normalize_answer(pred)), words(normalize_answer(gold)), _f1)


def token_f1_words(pred: Column | str, gold: Column | str) -> Column:
    """Token F1 on lower-cased words stripped of non-word characters; two empty texts score 1."""
    bare = lambda c: F.filter(F.transform(words(F.lower(col(c))), lambda w: F.regexp_replace(w, r"\W", "")), lambda w: w != "")
    return _bound(bare(pred), bare(gold), lambda a, b: F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(_f1(a, b)))


def exact_match(pred: Column | str, gold: Column | str) -> Column:
    return normalize_answer(pred) == normalize_answer(gold)


def exact_match_trimmed(pred: Column | str, gold: Column | str) -> Column:
    """Equality after trimming and lower-casing only."""
    return F.lower(F.trim(col(pred))) == F.lower(F.trim(col(gold)))


def substring_match(pred: Column | str, gold: Column | str) -> Column:
    """The normalised gold is in the normalised prediction; an empty gold always is."""
    return F.contains(normalize_answer(pred), normalize_answer(gold))


def best_over(golds: Column, metric) -> Column:
    """Maximum of a metric over an array of golds."""
    return F.array_max(F.transform(golds, metric))


def parse_output(c: Column | str, prefix: str = "Answer:") -> Column:
    """What follows the prefix on its line, else the first line; a repeated prefix is dropped."""
    text = col(c)
    hit = F.when(text.rlike(f"(?i){prefix}"), F.regexp_extract(text, f"(?i){prefix}(.*)(?:\n|$)", 1)).otherwise(F.regexp_extract(text, "^(.*)(?:\n|$)", 1))
    return F.trim(F.regexp_replace(F.trim(hit), f"(?i)^{prefix}", ""))


def retrieval_query(c: Column | str) -> Column:
    """The question part of a prompt: after one of two markers, else all of it."""
    text = col(c)
    first, second = "Now Answer the Question:", "Here is the conversation:"
    return F.when(text.contains(first), F.trim(F.regexp_extract(text, f"(?s){first}\\s*(.*)", 1))).when(text.contains(second), F.trim(F.regexp_extract(text, f"(?s){second}\\s*(.*)", 1))).otherwise(text)


def clean_item(c: Column | str) -> Column:
    """A list item without parentheses, leading number and extra white space."""
    bare = F.regexp_replace(col(c), r"\([^()]*\)", "")
    return squeeze(F.regexp_replace(bare, r"^(?:\d+[.)、]?\s*[-—–]?\s*)?", ""))


def clean_title(c: Column | str) -> Column:
    """Last path segment with ``_ - >`` as spaces and without parentheses."""
    last = F.element_at(F.split(col(c), "/"), -1)
    return squeeze(F.regexp_replace(F.translate(last, "_->", "   "), r"\([^()]*\)", ""))


def recommendation_items(c: Column | str) -> Column:
    """Items of a numbered list from ``1.`` on, else of a comma list."""
    text = col(c)
    at = F.instr(text, "1.")
    body = F.when(at > 0, F.substring(text, at + 2, F.length(text))).otherwise(F.replace(text, F.lit(","), F.lit("\n")))
    return F.transform(F.split(body, "\n"), lambda x: clean_item(F.trim(x)))


def normalize_phrase(c: Column | str) -> Column:
    """Lower case; all but ASCII letters, digits and spaces become spaces; trimmed."""
    return F.trim(F.lower(F.regexp_replace(col(c), "[^A-Za-z0-9 ]", " ")))


def node_key(c: Column | str) -> Column:
    """Lower case, spaces as underscores, no apostrophes."""
    return F.translate(F.lower(col(c)), " '", "_")


def strip_code_fence(c: Column | str) -> Column:
    """The body of a fenced block, else the trimmed text."""
    text = F.trim(col(c))
    return F.when(text.rlike(r"(?s)^```[A-Za-z0-9]*\n.*\n```$"), F.regexp_extract(text, r"(?s)^```[A-Za-z0-9]*\n(.*)\n```$", 1)).otherwise(text)


def last_json_object(c: Column | str) -> Column:
    """The last ``{...}`` without inner closing brace, as text; null if there is none."""
    found = F.regexp_extract_all(col(c), F.lit(r"(?s)\{.*?\}"), F.lit(0))
    return F.try_element_at(found, F.lit(-1))


def section(c: Column | str, name: str) -> Column:
    """Body of a ``[[ ## name ## ]]`` section up to the next header."""
    return F.trim(F.regexp_extract(col(c), rf"(?s)\[\[ ## {name} ## \]\]\s*(.*?)\s*(?=\[\[ ## |$)", 1))


def fill_template(template: Column | str, fields: dict[str, Column]) -> Column:
    """Replaces ``{key}``; unknown keys stay as they are."""
    out = col(template) if isinstance(template, Column) else F.lit(template)
    for key, value in fields.items():
        out = F.replace(out, F.lit("{" + key + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def edge_date_range(valid_at: Column, invalid_at: Column) -> Column:
    show = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return F.concat(F.coalesce(show(valid_at), F.lit("date unknown")), F.lit(" - "), F.coalesce(show(invalid_at), F.lit("present")))


def messages_text(messages: Column) -> Column:
    """``role: content`` lines of an array of messages."""
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")


def token_count(c: Column | str) -> Column:
    """The default tokenizer's count: white-space words."""
    return F.size(words(c))


def keep_tail(c: Column | str, n: int) -> Column:
    """The last ``n`` words."""
    return let(words(c), lambda w: F.array_join(F.slice(w, F.greatest(F.lit(1), F.size(w) - n + 1), F.lit(n)), " "))


def keep_head(c: Column | str, n: int) -> Column:
    """The first ``n`` words."""
    return F.array_join(F.slice(words(c), 1, n), " ")


def entities(c: Column | str, kind: str) -> Column:
    """All hits of one typed pattern, repeats and overlapping types included."""
    return F.regexp_extract_all(col(c), F.lit(POSSESSIVE_PATTERNS.get(kind, ENTITY_PATTERNS[kind][0])), F.lit(0))


def block_append(block: Column | str, text: Column | str) -> Column:
    return F.concat(col(block), F.lit("\n"), col(text))


def block_replace(block: Column | str, old: Column, new: Column) -> Column:
    """Replaces a text that must be there."""
    return F.when(F.contains(col(block), old), F.replace(col(block), old, new)).otherwise(F.raise_error(F.concat(F.lit("not in the block: "), old)))


def block_insert(block: Column | str, line: int, text: Column) -> Column:
    """Inserts after ``line`` lines; -1 appends."""
    parts = F.split(col(block), "\n")
    at = F.size(parts) if line < 0 else F.lit(line)
    return F.array_join(F.concat(F.slice(parts, F.lit(1), at), F.array(text), F.slice(parts, at + 1, F.size(parts) + 1)), "\n")


def event_section(c: Column | str, start: str, ends: list[str]) -> Column:
    """Text after the last start marker, up to the earliest end marker behind it; else the question part."""
    text = col(c)
    tail = F.element_at(F.split(text, f"\\Q{start}\\E"), -1)
    cut = tail
    for e in ends:
        cut = F.substring_index(cut, e, 1)
    return F.when(text.contains(start), F.trim(cut)).otherwise(retrieval_query(text))


def json_field(c: Column | str, schema: str, key: str) -> Column:
    """One field of a JSON answer, read by schema; null where it does not parse."""
    return F.try_variant_get(F.try_parse_json(strip_code_fence(c)), f"$.{key}", schema)


def named_entities(c: Column | str) -> Column:
    return json_field(c, "array<string>", "named_entities")


def triples(c: Column | str) -> Column:
    """``(s, p, o)`` of a JSON answer; lists that are not of three, and repeats, are dropped."""
    found = json_field(c, "array<array<string>>", "triples")
    three = F.filter(found, lambda t: F.size(t) == 3)
    return F.array_distinct(F.transform(three, lambda t: F.struct(t[0].alias("s"), t[1].alias("p"), t[2].alias("o"))))


def chat(system: Column, user: Column) -> Column:
    """System and user messages."""
    return F.array(F.struct(F.lit("system").alias("role"), system.alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))


def relation_lines(relations: Column) -> Column:
    """``source -- relationship -- destination`` lines."""
    return F.array_join(F.transform(relations, lambda r: F.concat_ws(" -- ", r["source"], r["relationship"], r["destination"])), "\n")


def search_context(facts: Column, names: Column, episodes: Column) -> Column:
    """Facts, entities and episodes as the sections of a prompt."""
    part = lambda title, xs: F.concat(F.lit(f"# {title}\n"), F.array_join(F.transform(xs, lambda x: F.concat(F.lit("- "), x)), "\n"))
    return F.concat_ws("\n\n", part("FACTS", facts), part("ENTITIES", names), part("EPISODES", episodes))


def first_chars(c: Column | str, n: int) -> Column:
    return F.substring(col(c), 1, n)


def tabs_to_spaces(c: Column | str) -> Column:
    return F.translate(col(c), "\t", " ")


def first_line(c: Column | str) -> Column:
    return F.substring_index(col(c), "\n", 1)


def concept(c: Column | str) -> Column:
    """Stand-in for a lemma: lower case, trimmed, and a plural's ending taken off."""
    text = F.lower(F.trim(col(c)))
    many = F.when(text.rlike("[^aeiou]ies$"), F.regexp_replace(text, "ies$", "y")).when(text.rlike("(ss|sh|ch|x|z)es$"), F.regexp_replace(text, "es$", ""))
    return many.when(text.rlike("[^sui]s$"), F.regexp_replace(text, "s$", "")).otherwise(text)
