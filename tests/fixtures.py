"""Fixed values of the published eight-unit panel, in natural order.

Rows are units (first three columns of the panel key), columns the years
2017..2024; dates are days of the year, None where no date was found.
"""

YEARS = list(range(2017, 2025))
POST = [2019, 2020, 2021]
TREATED = ["Baleshwar", "Bhadrak", "Jagatsinghpur", "Kendrapara", "Puri"]

SOS = {
    "Angul": [288, 258, 196, 167, 166, 166, 196, 197],
    "Baleshwar": [288, 135, 227, 167, 166, 258, 196, 167],
    "Bhadrak": [319, 135, 258, 259, 196, 258, 258, 197],
    "Cuttack": [288, 288, 196, 136, 166, 196, 196, 197],
    "Dhenkanal": [288, 288, 196, 136, 166, 166, 196, 197],
    "Jagatsinghpur": [288, 288, 227, 167, 166, 258, 196, 167],
    "Kendrapara": [319, 288, 196, 167, 166, 258, 196, 167],
    "Puri": [288, 288, 196, 197, 166, 258, 258, 197],
}
POS = {
    "Angul": [288, 258, 288, 289, 288, 288, 288, 289],
    "Baleshwar": [288, 288, 288, 289, 288, 288, 288, 289],
    "Bhadrak": [319, 288, 288, 289, 288, 288, 288, 289],
    "Cuttack": [288, 288, 288, 289, 288, 288, 288, 289],
    "Dhenkanal": [288, 288, 288, 289, 288, 288, 258, 289],
    "Jagatsinghpur": [288, 288, 319, 289, 288, 288, 288, 320],
    "Kendrapara": [319, 288, 319, 289, 288, 288, 288, 289],
    "Puri": [288, 288, 288, 289, 288, 288, 288, 289],
}
EOS = {
    "Angul": [None, 349, None, 350, 349, 349, 349, 350],
    "Baleshwar": [349, 349, 349, 350, 349, 349, 349, 350],
    "Bhadrak": [349, 349, 349, 350, 349, 349, 349, 350],
    "Cuttack": [None, 349, 349, 350, None, None, None, None],
    "Dhenkanal": [None, 349, 349, 350, 349, 349, 349, 350],
    "Jagatsinghpur": [None, 349, None, None, None, None, None, None],
    "Kendrapara": [None, 349, 349, 350, None, None, None, None],
    "Puri": [349, 349, 349, 350, 349, 349, 349, 350],
}
METRICS = {"SOS": SOS, "POS": POS, "EOS": EOS}
SHIFT_DAYS = {"SOS": 14.0, "POS": 7.0, "EOS": 21.0}

# Flooded share of each unit in the three event years.
SHARES = {
    2019: {"Angul": 0.0, "Baleshwar": 0.0, "Bhadrak": 0.000991, "Cuttack": 0.013112, "Dhenkanal": 0.0, "Jagatsinghpur": 0.002912, "Kendrapara": 0.005352, "Puri": 0.025188},
    2020: {"Angul": 0.0, "Baleshwar": 0.0033408044, "Bhadrak": 0.0078504425, "Cuttack": 4.61646659e-05, "Dhenkanal": 0.0, "Jagatsinghpur": 0.01921020003, "Kendrapara": 0.007904381972, "Puri": 0.00039699208},
    2021: {"Angul": 7.3207343e-06, "Baleshwar": 0.005292204089, "Bhadrak": 0.07212388587, "Cuttack": 0.000177129207, "Dhenkanal": 1.08239153e-05, "Jagatsinghpur": 0.03255890827, "Kendrapara": 0.02903457325, "Puri": 0.004180024294},
}
# The correction was applied to the treated units and to Cuttack.
SHIFTED = [*TREATED, "Cuttack"]


def panel(spark):
    rows = []
    for metric, table in METRICS.items():
        for unit, vals in table.items():
            for year, v in zip(YEARS, vals):
                rows.append((unit, year, metric, None if v is None else float(v), int(unit in TREATED), int(year in POST)))
    return spark.createDataFrame(rows, "unit string, year int, metric string, y double, treat int, post int")


def shares(spark):
    rows = [(u, y, f, "fixed") for y, t in SHARES.items() for u, f in t.items()]
    return spark.createDataFrame(rows, "unit string, year int, share double, source string")


def corrected_panel(spark):
    from pyspark.sql import functions as F

    from furrow.operators.panel import bounded_shift

    p = panel(spark)
    eligible = F.col("unit").isin(SHIFTED) & F.col("year").isin(POST)
    c = bounded_shift(p, shares(spark), ["unit", "year"], "y", "metric", SHIFT_DAYS, eligible)
    raw = p.withColumn("product", F.lit("raw"))
    cor = c.withColumn("y", F.col("corrected")).select(*p.columns).withColumn("product", F.lit("corrected"))
    return raw.unionByName(cor)
