"""Best representatives against plain Python."""

import json
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from spandrel.llm.contributions import _filled, survivors
from tests.conftest import rows

T0 = datetime(2025, 1, 1)
NF = "symbol string, file string, is_def int, data string, extracted_at timestamp_ntz, tie string, mask string"


def test_survivors_against_brute_force(spark):
    r = random.Random(5)
    table = []
    for i in range(400):
        d = {"signature": r.choice(["f()", " ", None, "TODO", "g(x)"]), "doc": r.choice(["-", "N/A", "says", "t.b.d.", 5]), "metadata": r.choice([{}, None, {"visibility": "public", "is_declaration": r.choice([True, "true", 1, 0, False])}])}
        text = r.choice([json.dumps(d)] * 6 + ["{", None, "", "nan", "[1]"])
        table.append(("hot" if r.random() < 0.3 else f"s{r.randrange(30)}", r.choice(["a", "./b", "c//d", "b"]), r.choice([0, 1, None]), text, T0 + timedelta(days=r.randrange(6)), "t", "m"))
    table.append((None, "a", 1, "{}", T0, "t", "m"))
    best = {}
    files = {}
    for s, f, is_def, text, at, *_ in table:
        f = f.replace("//", "/").removeprefix("./")
        try:
            d = json.loads(text, parse_constant=lambda x: 1 / 0)
        except (ValueError, TypeError, ZeroDivisionError):
            continue
        if s is None:
            continue
        files.setdefault(s, set()).add(f)
        d = d if isinstance(d, dict) else {}
        m = d.get("metadata") or {}
        declares = m.get("is_declaration") in (True, "true", 1)
        trust = (is_def == 1) if is_def is not None else not declares
        for name, v in (("signature", d.get("signature")), ("doc", d.get("doc")), ("visibility", m.get("visibility"))):
            if _filled(v) is not None:
                key = (not trust, -at.timestamp(), f)
                if (s, name) not in best or key < best[s, name]:
                    best[s, name] = key
    want = sorted((s, n, k[2]) for (s, n), k in best.items() if len(files[s]) > 1)
    got = survivors(spark.createDataFrame(table, NF), values=False, min_names=2)
    flat = got.select("symbol", F.explode(F.array(*(F.struct(F.lit(f).alias("n"), F.col(f"{f}.source").alias("s")) for f in ("signature", "doc", "visibility")))).alias("x")).select("symbol", "x.n", "x.s").where("s is not null")
    assert rows(flat) == want
    assert survivors(spark.createDataFrame([], NF), values=True, min_names=1).count() == 0
