from tableflow.operators import quality

ROWS = [
    ("T-1", "Ann Example", "a@example.com", "555-555-0100", "123-45-6789", "1111 2222 3333 4444", "192.0.2.1", "free", None),
    ("T-2", "Bob Example", "b@example.com", "(555) 555-0101", "987-65-4321", "1111-2222-3333-4445", "192.0.2.2", "pro", None),
    ("T-3", "Cyd Example", "unknown", None, None, None, "host", "pro", None),
]
SCHEMA = (
    "ticket_id string, customer_name string, contact string, tel string, national_id string,"
    " payment string, origin string, plan string, home_address string"
)


def test_scan_finds_each_pattern(spark):
    found = quality.scan_sensitive(spark.createDataFrame(ROWS, SCHEMA)).collect()
    got = {(r.column_name, r.pattern): r.ratio for r in found}
    assert got == {
        ("customer_name", None): None,
        ("contact", "email"): 0.67,
        ("tel", "phone_number"): 1.0,
        ("national_id", "ssn_like"): 1.0,
        ("payment", "credit_card_like"): 1.0,
        ("origin", "ip_address"): 0.67,
    }


def test_only_string_columns_are_scanned(spark):
    df = spark.sql("SELECT 1 AS email, 2.0D AS phone, 'x' AS note")
    assert quality.scan_sensitive(df).count() == 0


def report(spark, rows, schema):
    df = spark.createDataFrame(rows, schema)
    return quality.triage_report(df, quality.scan_sensitive(df)).first()


def test_three_verdicts(spark):
    sure = report(spark, ROWS, SCHEMA)
    assert sure.confirmed == ["contact", "tel", "national_id", "payment", "origin"]
    assert sure.worth_a_look == ["customer_name"] and (sure.n_rows, sure.columns_scanned) == (3, 9)
    assert sure.verdict.startswith("5 column(s)") and "restricted" in sure.verdict
    hint = report(spark, [("x", 1)], "birth_place string, n int")
    assert hint.confirmed == [] and hint.verdict.startswith("no confirmed pattern matches, but 1 ")
    clean = report(spark, [("x",)], "note string")
    assert clean.verdict == "no sensitive-looking columns found by these checks (not a guarantee)"


def test_profile(spark):
    got = quality.profile(spark.createDataFrame(ROWS, SCHEMA)).collect()
    assert len(got) == 9 and {r.row_count for r in got} == {3}
