"""Training datasets read what they come from once."""

from __future__ import annotations

from wiretally.operators import datasets


def test_names_are_drawn_once(spark):
    drawn = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            drawn.add(len(b))
            yield b

    rows = [(f"name{i}", i % 2, "de" if i % 3 == 0 else "en") for i in range(120)]
    names = spark.createDataFrame(rows, "domain string, label int, family string").mapInArrow(run, "domain string, label int, family string")
    d = datasets.name_dataset(names, "de")
    held = sum(label == 1 and family == "de" for _, label, family in rows)
    for _ in range(2):
        assert d.filter("split = 'unseen_family' and label = 1").count() == held
        assert d.filter("split <> 'unseen_family'").count() == 120 - held
    assert drawn.value == 120
