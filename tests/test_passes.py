"""A pass that stops anywhere does each document once when it is resumed."""

import pytest

from parchment.operators import listing
from tests.oracles import SMALL, assert_same, connection


@pytest.mark.parametrize("stops", [(), (1,), (1, 1, 2)])
def test_each_document_once_however_it_is_cut(spark, stops):
    rows = [(k, "" if k % 5 == 0 else "x" * (k % 7)) for k in range(40)] + [(41, None), (None, "lost")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    held, seen = [0, 3], []  # done before; those whose number divides by four never get a row

    def work(chunk):
        ids = [r.doc_id for r in chunk.collect()]
        assert len(ids) <= 6
        seen.extend(ids)
        held.extend(k for k in ids if k % 4)

    done = lambda: spark.createDataFrame([(k,) for k in held], "doc_id int")
    after = None
    for n in stops:
        left = [n]

        def until(left=left):
            left[0] -= 1
            return left[0] < 0

        after, complete = listing.resumed_pass(docs, done, work, after, 6, until)
        assert not complete
    after, complete = listing.resumed_pass(docs, done, work, after, 6)
    assert complete and sorted(seen) == [k for k, t in rows if k is not None and t and k != 3]
    assert listing.resumed_pass(docs.limit(0), done, work) == (None, True)


def test_pending_equals_its_sql(spark):
    assert_same(listing.documents_pending(spark, SMALL), connection(), listing.REGISTRY.oracles["documents_pending"])
    plan = listing.documents_pending(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(doc_id" in plan
