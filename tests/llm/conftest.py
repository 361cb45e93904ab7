import pytest


@pytest.fixture
def docs_of(spark):
    """Documents of (doc_id, text) rows with clashing extra columns and several partitions."""

    def make(rows, partitions=3, **columns):
        extra = {"rid": "x", "size": 1, "_key": "y", "n": 2, "label": 3} | columns
        fields = ["doc_id long", "text string", "lang string", "source string", *(f"{k} {'string' if isinstance(v, str) else 'long'}" for k, v in extra.items())]
        full = [(r + (None,) * 4)[:4] + tuple(extra.values()) for r in rows]
        return spark.createDataFrame(full, ", ".join(fields)).repartition(partitions)

    return make
