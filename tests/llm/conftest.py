import pytest

GOLD = "row_id bigint, claim_id string, split string, paper_id string, claim string, label string, caption string, evi_type string, context string, domain string, use_context string, operation string, paper_path string, claim_id_pair string, source string, lang string"
FIELDS = [f.split()[0] for f in GOLD.split(", ")]


@pytest.fixture
def gold(spark):
    """A task1_gold of the given rows; fields that aren't given are null."""

    def make(*rows):
        return spark.createDataFrame([tuple(r.get(f, i if f == "row_id" else None) for f in FIELDS) for i, r in enumerate(rows, 1)], GOLD)

    return make


@pytest.fixture
def documents(spark):
    def make(*texts):
        return spark.createDataFrame([(i, t) for i, t in enumerate(texts, 1)], "doc_id bigint, text string")

    return make
