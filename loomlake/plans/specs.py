"""Declarative models: silver tables, measures and business-intelligence artifacts."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    expression: str
    sources: tuple[tuple[str, str], ...]
    kind: str = "rename"  # rename, concat or calculation


@dataclass(frozen=True)
class JoinStep:
    table: str
    on: str  # a column that both sides have


@dataclass(frozen=True)
class TableSpec:
    name: str
    base: str
    joins: tuple[JoinStep, ...]
    columns: tuple[ColumnSpec, ...]


def _same(table: str, *names: str) -> tuple[ColumnSpec, ...]:
    return tuple(ColumnSpec(n, f"{table}.{n}", ((table, n),)) for n in names)


AS_OF = "2024-07-01"
#: Key of each raw table, and the columns a silver table may use.
RAW_KEYS = {"patients": "patient_id", "visits": "visit_id", "billing": "billing_id"}

CLINICAL = TableSpec(
    "patient_clinical_records",
    "visits",
    (JoinStep("patients", "patient_id"),),
    (
        *_same("patients", "patient_id"),
        ColumnSpec("full_name", "patients.first_name || ' ' || patients.last_name", (("patients", "first_name"), ("patients", "last_name")), "concat"),
        ColumnSpec(
            "age",
            f"cast(datediff(date'{AS_OF}', case when patients.dob rlike '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$' then try_cast(patients.dob as date) end) / 365.25 as int)",
            (("patients", "dob"),),
            "calculation",
        ),
        *_same("patients", "gender", "blood_type"),
        *_same("visits", "visit_date", "department", "diagnosis", "doctor_name", "treatment", "status"),
    ),
)
FINANCIAL = TableSpec(
    "financial_records",
    "billing",
    (JoinStep("visits", "visit_id"), JoinStep("patients", "patient_id")),
    (
        *_same("visits", "visit_id", "patient_id", "department"),
        *_same("billing", "procedure_code"),
        *_same("visits", "bill_amount"),
        *_same("billing", "insurance_covered"),
        ColumnSpec("out_of_pocket", "visits.bill_amount - billing.insurance_covered", (("visits", "bill_amount"), ("billing", "insurance_covered")), "calculation"),
        *_same("billing", "copay_amount"),
        *_same("patients", "insurance_provider"),
        *_same("billing", "payment_status", "billing_date"),
    ),
)
SILVER = (CLINICAL, FINANCIAL)


@dataclass(frozen=True)
class Measure:
    name: str
    aggregate: str  # count, avg, sum, distinct, count_where or ratio
    columns: tuple[str, ...] = ()
    value: str | None = None
    text: str = ""


@dataclass(frozen=True)
class BiColumn:
    name: str
    kind: str
    column: str  # logical silver column


@dataclass(frozen=True)
class Dataset:
    id: str
    name: str
    table: str
    silver: str
    columns: tuple[BiColumn, ...]
    measures: tuple[Measure, ...] = field(default=())


# The semantic model's names, types and measure texts.
DATASETS = (
    Dataset(
        "clinical", "Patient Clinical Analytics", "PatientClinical", "patient_clinical_records",
        tuple(
            BiColumn(n, k, c)
            for n, k, c in (
                ("PatientID", "String", "patient_id"), ("FullName", "String", "full_name"), ("Age", "Int64", "age"), ("Gender", "String", "gender"),
                ("BloodType", "String", "blood_type"), ("VisitDate", "DateTime", "visit_date"), ("Department", "String", "department"),
                ("Diagnosis", "String", "diagnosis"), ("DoctorName", "String", "doctor_name"), ("Treatment", "String", "treatment"), ("VisitStatus", "String", "status"),
            )
        ),
        (
            Measure("Patient Count", "count", ("patient_id",), None, "COUNTROWS(PatientClinical)"),
            Measure("Avg Patient Age", "avg", ("age",), None, "AVERAGE(PatientClinical[Age])"),
            Measure("Unique Departments", "distinct", ("department",), None, "DISTINCTCOUNT(PatientClinical[Department])"),
            Measure("Active Visits", "count_where", ("status",), "Completed", 'CALCULATE(COUNTROWS(PatientClinical), PatientClinical[VisitStatus]="Completed")'),
        ),
    ),
    Dataset(
        "financial", "Financial Performance", "FinancialRecords", "financial_records",
        tuple(
            BiColumn(n, k, c)
            for n, k, c in (
                ("VisitID", "String", "visit_id"), ("PatientID", "String", "patient_id"), ("Department", "String", "department"), ("ProcedureCode", "String", "procedure_code"),
                ("BillAmount", "Double", "bill_amount"), ("InsuranceCovered", "Double", "insurance_covered"), ("PatientCopay", "Double", "copay_amount"),
                ("OutOfPocket", "Double", "out_of_pocket"), ("InsuranceProvider", "String", "insurance_provider"), ("PaymentStatus", "String", "payment_status"), ("BillingDate", "DateTime", "billing_date"),
            )
        ),
        (
            Measure("Total Revenue", "sum", ("bill_amount",), None, "SUM(FinancialRecords[BillAmount])"),
            Measure("Avg Copay", "avg", ("copay_amount",), None, "AVERAGE(FinancialRecords[PatientCopay])"),
            Measure("Insurance Coverage Rate", "ratio", ("insurance_covered", "bill_amount"), None, "DIVIDE(SUM(FinancialRecords[InsuranceCovered]), SUM(FinancialRecords[BillAmount]))"),
            Measure("Total Out Of Pocket", "sum", ("out_of_pocket",), None, "SUM(FinancialRecords[OutOfPocket])"),
            Measure("Paid Claims", "count_where", ("payment_status",), "Paid", 'CALCULATE(COUNTROWS(FinancialRecords), FinancialRecords[PaymentStatus]="Paid")'),
        ),
    ),
)
# A model of our own around the two datasets: reports, dashboards, tiles and past refreshes.
#: (id, name, dataset id)
REPORTS = (
    ("who-we-treat", "Who We Treat", "clinical"),
    ("ward-load", "Ward Load", "clinical"),
    ("money-in", "Money In", "financial"),
    ("payer-share", "Payer Share", "financial"),
)
#: (id, name)
DASHBOARDS = (("board-room", "Board Room"), ("front-desk", "Front Desk"))
#: (id, title, dashboard id, report id, dataset id)
TILES = (
    ("b1", "Patient count, all sites", "board-room", "who-we-treat", "clinical"),
    ("b2", "Total revenue to date", "board-room", "money-in", "financial"),
    ("b3", "Insurance coverage rate by payer", "board-room", "payer-share", "financial"),
    ("b4", "Wards and their cases", "board-room", "ward-load", "clinical"),
    ("f1", "Active visits now", "front-desk", "ward-load", "clinical"),
    ("f2", "Avg copay at the desk", "front-desk", "money-in", "financial"),
    ("f3", "Claims still open", "front-desk", "payer-share", "financial"),
    ("f4", "Avg patient age by ward", "front-desk", "who-we-treat", "clinical"),
)
#: (dataset id, kind, start, end, status, request id)
REFRESHES = (
    ("clinical", "Scheduled", "2024-06-28T02:00:00Z", "2024-06-28T02:04:10Z", "Completed", "c-17"),
    ("clinical", "Scheduled", "2024-06-29T02:00:00Z", "2024-06-29T02:03:55Z", "Completed", "c-18"),
    ("clinical", "OnDemand", "2024-06-29T09:30:00Z", "2024-06-29T09:31:00Z", "Failed", "c-19"),
    ("financial", "Scheduled", "2024-06-28T03:00:00Z", "2024-06-28T03:10:00Z", "Completed", "f-4"),
    ("financial", "Scheduled", "2024-06-29T03:00:00Z", "2024-06-29T03:09:20Z", "Completed", "f-5"),
)
