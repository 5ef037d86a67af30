"""Detection quality on generated sentences."""

import collections

from maskwright.functions.samples import SAMPLES, sample_documents, sample_row
from maskwright.functions.validators import PREDICATES
from maskwright.operators.entities import Detector


def test_recall_by_type():
    d, hit, all_ = Detector("zh"), collections.Counter(), collections.Counter()
    for i in range(400):
        text, spans = sample_row(i, 3)
        found = {(e.type, e.text) for e in d.detect(text).entities}
        for s in spans:
            assert text[s["start"] : s["end"]] == s["text"]
            all_[s["type"]] += 1
            hit[s["type"]] += (s["type"], s["text"]) in found
    low = {k: (hit[k], n) for k, n in all_.items() if hit[k] < 0.8 * n}
    assert not low, low
    assert sum(hit.values()) >= 0.94 * sum(all_.values())


def test_values_pass_their_checks(spark):
    for row in sample_documents(spark, 40, seed=1, values=len(SAMPLES)).collect():
        by = {e.type: e.text for e in row.entities}
        assert PREDICATES["cn_id"](by["id_number"]) and PREDICATES["luhn"](by["bank_card"]) and PREDICATES["credit_code"](by["credit_code"])
        assert row.text == sample_row(row.doc_id, 1, len(SAMPLES))[0]
