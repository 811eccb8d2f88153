"""What queries shuffle, and what a task holds."""

import pyarrow as pa
import pytest

from memlake.operators import chunking as C
from memlake.plans import catalog

catalog.load()


@pytest.mark.parametrize("name", ["chunk_words", "top_words"])
def test_texts_are_shuffled_not_their_words(spark, sf_dir, name):
    """All exchanges lie below the step that makes words of texts."""
    plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    above, below = plan.split("Generate", 1)
    assert "Exchange" not in above and "Exchange" in below


def test_a_worker_sends_chunks_as_they_come(spark, monkeypatch):
    """Three hundred texts of forty sentences are sent in many batches, not as one."""
    seen = []
    monkeypatch.setattr(C, "SENT", 100)
    text = "One two three. " * 40
    docs = spark.createDataFrame([(i, text) for i in range(300)] + [(300, ""), (301, None)], "doc_id long, text string").coalesce(1)

    class Rows:
        """Takes the function that goes to the workers, and runs it here."""

        def __getattr__(self, name):
            return getattr(docs, name)

        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            seen.extend(run(iter(pa.Table.from_pylist([r.asDict() for r in docs.collect()], schema=pa.schema([("doc_id", pa.int64()), ("text", pa.string())])).to_batches())))

    C._chunked(Rows(), lambda t: C.split_sentences(t or "", 64, C.one_per_word), "doc_id", "text")
    assert sum(b.num_rows for b in seen) == 300 * 40 and max(b.num_rows for b in seen) < 200
    assert C.sentence_chunks(docs, 64).count() == 300 * 40


def test_triples_are_dealt_once(spark, sf_dir):
    """What a chunk has is known where its rows lie: one exchange of rows, and one of entities' counts."""
    plan = catalog.QUERIES["entity_frequency"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
