"""Small literal inputs shared by the tests."""

import random

LANDED = (
    "CASE_NUMBER string, CASE_STATUS string, VISA_CLASS string, DECISION_DATE string, RECEIVED_DATE string, "
    "EMPLOYER_NAME string, TOTAL_WORKER_POSITIONS string, SOURCE_RELEASE string, SOURCE_ROW_NUMBER long"
)
# Two companies; P2 is revised into the next quarter, P4 is of another class, P6 has no date.
VERSIONED = {
    "FY2019_Q2": [
        ("P1", "Certified", "H-1B", "2019-01-14", "Birch Works, Inc.", "4"),
        ("P2", "Denied", "H-1B", "2019-02-11", "BIRCH WORKS INC", "1"),
        ("P3", "Certified", "H-1B", "2019-03-08", "Delta Foods", "7"),
        ("P4", "Certified", "H-1B1", "2019-03-09", "Delta Foods", "50"),
    ],
    "FY2019_Q3": [
        ("P2", "Certified", "H-1B", "2019-04-02", "Birch  Works Inc.", "3"),
        ("P5", "Certified", "H-1B", "2019-05-20", "birch works, inc", "2"),
        ("P6", "Withdrawn", "H-1B", None, "Delta Foods", "9"),
    ],
    "FY2020_Q1": [
        ("P7", "Certified", "H-1B", "2019-11-05", "Birch Works Inc", "6"),
        ("P8", "Certified", "H-1B", "2019-12-01", "Delta Foods", "2"),
    ],
}
# Case, status, class, decision and receipt day, company, positions.
PROFILED = {
    "FY2019_Q2": [
        ("R1", "Certified", "H-1B", "2019-01-20", "2018-12-28", "Cedar Labs", "3"),
        ("R2", "Certified", "H-1B", "2019-02-14", "2019-02-01", "Elm", "2"),
        ("R3", "Denied", "H-1B1", "2019-03-01", "2019-02-25", "Cedar Labs", "8"),
    ],
    "FY2019_Q3": [
        ("R2", "Denied", "H-1B", "2019-04-16", "2019-02-01", "Elm Group", "4"),
        ("R4", "Withdrawn", "H-1B", None, "2019-03-30", "Fir", "5"),
        ("R5", "Certified", "H-1B", "2019-03-15", "2019-03-04", "Elm Group", "1"),
    ],
}
QUARTERS = [
    ("X", "FY2019_Q3", 5, 4, 9), ("X", "FY2019_Q4", 1, 1, 2), ("X", "FY2020_Q1", 0, 0, 0),
    ("X", "FY2020_Q2", 2, 0, 6), ("X", "FY2020_Q3", 0, 0, 0),
    ("Y", "FY2020_Q2", 3, 3, 3), ("Y", "FY2020_Q3", 1, 1, 1),
]


def versioned(spark):
    rows = [
        (case, status, visa, day, day, name, size, release, at)
        for release, cases in VERSIONED.items()
        for at, (case, status, visa, day, name, size) in enumerate(cases, 2)
    ]
    return spark.createDataFrame(rows, LANDED)


def profiled(spark):
    rows = [(*row, release, at) for release, cases in PROFILED.items() for at, row in enumerate(cases, 2)]
    return spark.createDataFrame(rows, LANDED)


def quarters(spark, *more):
    from panelwright.functions.calendar import label_number

    rows = [(e, label_number(q), c, f, p) for e, q, c, f, p in (*QUARTERS, *more)]
    return spark.createDataFrame(
        rows, "EMPLOYER_ID string, quarter int, LCA_CASES long, CERTIFIED_CASES long, REQUESTED_POSITIONS long"
    )


def activity_rows(length=18, companies=30):
    """Company, quarter index, cases: every company opens with a case, later ones are rarer for low numbers."""
    from panelwright.functions.calendar import label_number

    draw, first = random.Random(1907), label_number("FY2013_Q3")
    rows = []
    for c in range(companies):
        busy = 0.2 + 0.6 * (c + 1) / companies
        for t in range(length):
            cases = draw.randrange(1, 4 + c % 6) if draw.random() < busy else 0
            rows.append((f"firm_{c:02d}", f"FIRM {c}", first + t, cases if t else 1 + c % 2))
    return rows


def activity(spark, rows):
    return spark.createDataFrame(rows, "EMPLOYER_ID string, EMPLOYER_NAME string, quarter int, LCA_CASES long")
