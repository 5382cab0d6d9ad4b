"""Small hand-made records that reach the rules which the driver's texts do not."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RECORDS = [
    ("Tamsin's Bakehouse", "2210 Juniper Drive, Cedar Falls, NC", "US"),
    ("Quillon Technologies Corp.", "Suite 410, 88 S. Lark St., Austin, TX 73301", "US"),
    ("Verma Textiles Pvt. Ltd.", "Shop 9, Opp. Clock Tower 2, Sector 3, Rohtak 124001", "India"),
    ("Private Konkan Sólis Limited", "Konkan Estate, Nashik, Maharashtra", "India"),
    ("ZK Foundry Private Límited", "7 Lake Road, Mysore, Karnataka", "India"),
    ("NORTH LTD (FREIGHT) | www.northltd.com", "45 Harbor Row, Albany, NY", "US"),
    ("@silverpenny", "20413 Cobb Rd, Norman, Oklahoma", "US"),
    ("hollowpine.com", "0512 Beech Avenue, Terre Haute, Indiana", "US"),
    ("C0RAL HARBOR STUDIO", "77 N Elm St, Dallas TX", "US"),
    ("Brandt, Ho1loway & Pike LLP", "Canal St, San Jose, CA", "US"),
    ("Heron (India) Estates LLP", "Techpark, Kollam, Kerala", "India"),
    ("La Jolla Books", "10 Elm Ave, La Jolla, San Diego, California", "US"),
    ("Mountain Goods", "5 Oak Rd, Charleston, West Virginia", "US"),
    ("Pine Goods", "9 Pine Rd, Charleston, WV 25301", "US"),
    ("Librairie Hugo", "12 r Victor Hugo, Lille", "France"),
    ("Cafe St Martin", "3 r St Martin, Paris", "France"),
    ("Bellecour", "1 place Bellecour, Lyon", "France"),
    ("Hill One", "12345a Hill Rd", "US"),
    ("Hill Two", "1234567 Hill Rd", "US"),
    ("Cross", "1st Cross, Pune, Maharashtra", "India"),
    ("The Company Of Co", "", "US"),
    ("Laxmi + Choudhary Traders", "Plot No. 7-B, near to Marg, UP", "India"),
    ("NA", "Œuvre Straße 5, Île-de-France", "France"),
    (None, None, "US"),
    ("Nowhere", "1 Main Street", None),
]
COLUMNS = ("business_name", "business_address", "country")


def golden(spark: SparkSession) -> DataFrame:
    rows = [("G", f"G-{i}", *r) for i, r in enumerate(RECORDS)]
    return spark.createDataFrame(rows, "source string, entity_id string, business_name string, business_address string, country string")


def _literal(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def values_sql() -> str:
    return ", ".join(f"('G', 'G-{i}', {', '.join(map(_literal, r))})" for i, r in enumerate(RECORDS))
