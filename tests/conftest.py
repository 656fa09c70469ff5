import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .appName("loomlake-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


SCHEMAS = {
    "patients": "patient_id string, first_name string, last_name string, dob string, gender string, blood_type string, phone string, address string, insurance_provider string, load_id int, loaded_at timestamp_ntz",
    "visits": "visit_id string, patient_id string, visit_date string, department string, diagnosis string, doctor_name string, treatment string, bill_amount double, status string, clinic_id string, load_id int, loaded_at timestamp_ntz",
    "billing": "billing_id string, visit_id string, patient_id string, procedure_code string, insurance_covered double, copay_amount double, payment_status string, billing_date string, load_id int, loaded_at timestamp_ntz",
    "deleted_records": "table_name string, record_key string, deleted_at timestamp_ntz",
    "canonical_values": "field_name string, canonical_id string, canonical_value string",
    "documents": "doc_id long, text string, lang string, source string, n_chars int, post_type string, question_id long, answer_rank int, score int, is_accepted boolean, duplicate_of long, owner_id long, tags string",
}
#: Columns that operators use inside; a table may have its own of these names.
CLASHING = ("name", "value", "rank", "n", "k", "entity", "day", "grp", "place", "block", "node", "cell", "_pid", "rkey", "item_id")


@pytest.fixture
def folder(spark, tmp_path):
    """write(table=rows) puts small tables into a folder; missing fields are null, missing tables empty; every table has clashing columns."""
    from datetime import datetime

    from pyspark.sql import functions as F
    from pyspark.sql.types import StructType

    def write(**tables):
        at = tmp_path / f"d{len(list(tmp_path.iterdir()))}"
        for name, ddl in SCHEMAS.items():
            schema = StructType.fromDDL(ddl)
            rows = []
            for r in tables.get(name, []):
                full = {f.name: r.get(f.name) for f in schema.fields}
                if "load_id" in full and full["load_id"] is None:
                    full["load_id"] = 1
                if "loaded_at" in full and full["loaded_at"] is None:
                    full["loaded_at"] = datetime(2023, full["load_id"] % 12 or 12, 1)
                rows.append(tuple(full[f.name] for f in schema.fields))
            df = spark.createDataFrame(rows, schema)
            df = df.withColumns({c: F.lit("clash") for c in CLASHING if c not in df.columns})
            df.coalesce(1).write.parquet(str(at / f"{name}.parquet"))
        return str(at)

    return write
