import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def filing(spark):
    """Six pages of one invented filing: cover, contents, two reports, account and notes."""
    prose = "The directors present their report for the year and the board continues to invest in the stadium. " * 12
    pages = [
        "EXAMPLE CLUB HOLDINGS LIMITED\nAnnual Report\nFor the year ended 30 June 2024",
        "Contents\nStrategic Report 2\nDirectors' Report 6\nIndependent Auditor's Report 9\nConsolidated Profit and Loss Account 12\nNotes to the Financial Statements 16",
        "Strategic Report\n" + prose.replace(". ", ".\n"),
        "Directors' Report\n" + prose.replace(". ", ".\n"),
        "Consolidated Profit and Loss Account\nNote 2024 2023\n£'000 £'000\nTurnover 2 468,712 442,364\nOperating expenses (441,208) (409,552)\n"
        "Amortisation of players' registrations (118,940) (101,223)\nProfit on disposal of players' registrations 3 76,441 52,118\nProfit on disposal of fixed assets 4 82,500 -\nOperating profit 67,505 33,707",
        "Notes to the Financial Statements\n5 Staff costs\nWages and salaries 219,304 204,881\nSocial security costs 26,115 24,002\nTotal staff costs 245,419 228,883",
    ]
    return spark.createDataFrame([("c", "n", "2024", i + 1, t) for i, t in enumerate(pages)], "club string, company_number string, year string, page int, text string")
