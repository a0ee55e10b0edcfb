from __future__ import annotations

import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tarnish.session import drop_staged, local_session  # noqa: E402
from tarnish.spec import ICU_FLAGS, ICU_NUMERIC  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tarnish-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    drop_staged(session)
    session.stop()


@pytest.fixture(scope="session")
def icu(spark):
    """A small made-up cohort with the edge rows of its kind."""
    rng = random.Random(3)
    rows = []
    for i in range(240):
        row = {"subject_id": i, "hadm_id": 1000 + i, "stay_id": 5000 + i, "in_hospital_mortality": int(rng.random() < 0.3)}
        row["gender"] = None if i == 5 else rng.choice(["M", "F"])
        for c in ICU_NUMERIC:
            row[c] = float(rng.random() < 0.4) if c in ICU_FLAGS else round(rng.uniform(1, 100), 2)
        if i % 40 == 7:
            row[ICU_NUMERIC[i % 14]] = None
        if i == 11:
            row["aniongap_min"] = row["aniongap_max"]
        if i == 12:
            row.update(dict.fromkeys(ICU_FLAGS, 1.0))
        if i == 13:
            row["urine_output"] = 0.0
        rows.append(row)
    ddl = "subject_id long, hadm_id long, stay_id long, in_hospital_mortality int, gender string, "
    ddl += ", ".join(f"{c} double" for c in ICU_NUMERIC)
    names = ["subject_id", "hadm_id", "stay_id", "in_hospital_mortality", "gender", *ICU_NUMERIC]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ddl).repartition(4).cache()
