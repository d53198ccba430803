"""Parameters of the attrition pipeline.

Every date, mapping, threshold and label used by the staging and analysis
steps lives here, so that the same operators can run the bank's own
configuration or the fixture configuration derived from the test tables.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# ---------------------------------------------------------------------------
# Fixed values. These must equal the reference pipeline's values for the
# results to agree: variant spellings (after upper-casing and trimming),
# clean labels, band limits and band labels, in the reference's order.
# ---------------------------------------------------------------------------

PROVINCE_VARIANTS: dict[str, tuple[str, ...]] = {
    "Gauteng": ("GAUTENG", "GP", "GUATENG"),
    "KwaZulu-Natal": ("KWAZULU-NATAL", "KZN", "KWAZULU NATAL"),
    "Western Cape": ("WESTERN CAPE", "WC", "W CAPE"),
    "Eastern Cape": ("EASTERN CAPE", "EC", "E CAPE"),
    "Limpopo": ("LIMPOPO", "LP", "LIMPOP"),
    "Mpumalanga": ("MPUMALANGA", "MP"),
    "North West": ("NORTH WEST", "NW", "N WEST"),
    "Free State": ("FREE STATE", "FS", "FREESTATE"),
    "Northern Cape": ("NORTHERN CAPE", "NC", "N CAPE"),
}

GENDER_VARIANTS: dict[str, tuple[str, ...]] = {
    "Male": ("M", "MALE"),
    "Female": ("F", "FEMALE"),
}

PRODUCT_VARIANTS: dict[str, tuple[str, ...]] = {
    "Cheque Account": ("CHEQUE ACCOUNT", "CHEQUE ACC", "CA"),
    "Savings Account": ("SAVINGS ACCOUNT", "SAVINGS ACC", "SA"),
    "Home Loan": ("HOME LOAN", "HOME LN", "HL"),
    "Credit Card": ("CREDIT CARD", "CREDIT CRD", "CC"),
    "Personal Loan": ("PERSONAL LOAN", "PERSONAL LN", "PL"),
}

# Branch codes that are expanded; any other code is kept as loaded.
BRANCH_EXPANSIONS: dict[str, str] = {"JHB-CBD": "Johannesburg CBD"}

UNKNOWN = "Unknown"

# Age bands: inclusive ranges, then "above" for ages over the last limit.
AGE_RANGES: tuple[tuple[int, int, str], ...] = (
    (18, 25, "18-25"),
    (26, 35, "26-35"),
    (36, 45, "36-45"),
    (46, 55, "46-55"),
    (56, 65, "56-65"),
)
AGE_ABOVE: tuple[int, str] = (65, "65+")

# Bands of the form "value < limit -> label", tried in order, else the last label.
TENURE_BANDS: tuple[tuple[float, str], ...] = (
    (365, "Less than 1 Year"),
    (730, "1-2 Years"),
    (1825, "2-5 Years"),
)
TENURE_TOP = "5+ Years"

INCOME_TIERS: tuple[tuple[float, str], ...] = (
    (7000, "Below R7,000"),
    (15000, "R7,000 - R14,999"),
    (30000, "R15,000 - R29,999"),
    (60000, "R30,000 - R59,999"),
)
INCOME_TOP = "R60,000 & above"

BALANCE_TIERS: tuple[tuple[float, str], ...] = (
    (0, "Overdrawn"),
    (10000, "R0 - R9,999"),
    (50000, "R10,000 - R49,999"),
    (200000, "R50,000 - R199,999"),
)
BALANCE_TOP = "R200,000 & above"

CREDIT_BANDS: tuple[tuple[float, str], ...] = (
    (450, "Poor"),
    (600, "Fair"),
    (700, "Good"),
    (750, "Very Good"),
)
CREDIT_TOP = "Excellent"

# Transaction bands: exact zero first, then "< limit" bands.
TXN_ZERO_LABEL = "No Activity"
TXN_BANDS: tuple[tuple[float, str], ...] = (
    (5, "1-4"),
    (10, "5-9"),
    (20, "10-19"),
)
TXN_TOP = "20+"

OUTLIER_BALANCE = 1_000_000.0
CREDIT_SCORE_MIN = 300
CREDIT_SCORE_MAX = 850

# Severity of our own count of export rows with too few or too many fields.
MALFORMED_SEVERITY = "High"

# Severity of each profiling check (Critical / High / Medium / Low, N/A for
# baselines, Varies for the broad NULL sweeps).
CHECK_SEVERITY: dict[str, str] = {
    "DQ-01": "N/A",
    "DQ-02": "Varies",
    "DQ-03": "High",
    "DQ-04": "Medium",
    "DQ-05": "High",
    "DQ-06": "High",
    "DQ-07": "Low",
    "DQ-08": "Medium",
    "DQ-09": "N/A",
    "DQ-10": "Medium",
    "DQ-11": "Medium",
    "DQ-12": "High",
    "DQ-13": "Critical",
    "DQ-14": "N/A",
    "DQ-15": "Varies",
    "DQ-16": "Critical",
    "DQ-17": "High",
    "DQ-18": "Critical",
    "DQ-19": "High",
}

# Top-N report of retained, high-balance, low-engagement customers.
AT_RISK_LIMIT = 20
AT_RISK_MIN_BALANCE = 50000.0
AT_RISK_MAX_TXN = 5

PRODUCT_STATUS_ACTIVE = "Active"
PRODUCT_STATUS_CLOSED = "Closed"

# Bank dates of the reference: "present day", bank inception, calendar window.
BANK_REFERENCE_DATE = "2024-12-31"
BANK_INCEPTION_DATE = "2015-01-01"

# ---------------------------------------------------------------------------
# Fixture values (FIXTURES.md): dates of the test tables, and the province
# mapping of their five region names.
# ---------------------------------------------------------------------------

FIXTURE_REFERENCE_DATE = "2001-12-31"
FIXTURE_INCEPTION_DATE = "1995-01-01"

REGION_VARIANTS: dict[str, tuple[str, ...]] = {
    "Africa": ("AFRICA", "AF"),
    "America": ("AMERICA", "AM"),
    "Asia": ("ASIA", "AS"),
    "Europe": ("EUROPE", "EU"),
    "Middle East": ("MIDDLE EAST", "MI"),
}


@dataclass(frozen=True)
class ChurnConfig:
    """One set of parameters for the whole pipeline."""

    reference_date: str = BANK_REFERENCE_DATE
    inception_date: str = BANK_INCEPTION_DATE
    calendar_start: str = BANK_INCEPTION_DATE
    calendar_end: str = BANK_REFERENCE_DATE
    province_variants: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(PROVINCE_VARIANTS))
    gender_variants: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(GENDER_VARIANTS))
    product_variants: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(PRODUCT_VARIANTS))
    branch_expansions: dict[str, str] = field(default_factory=lambda: dict(BRANCH_EXPANSIONS))
    outlier_balance: float = OUTLIER_BALANCE
    #: Text compares without regard to case and trailing spaces (``functions.text.folded``).
    fold_text: bool = False

    @property
    def product_names(self) -> tuple[str, ...]:
        return tuple(self.product_variants)

    def with_dates(self, reference_date: str, inception_date: str) -> "ChurnConfig":
        return replace(
            self,
            reference_date=reference_date,
            inception_date=inception_date,
            calendar_start=inception_date,
            calendar_end=reference_date,
        )

    def with_folded_text(self) -> "ChurnConfig":
        return replace(self, fold_text=True)


BANK = ChurnConfig()

FIXTURE = ChurnConfig(
    reference_date=FIXTURE_REFERENCE_DATE,
    inception_date=FIXTURE_INCEPTION_DATE,
    calendar_start=FIXTURE_INCEPTION_DATE,
    calendar_end=FIXTURE_REFERENCE_DATE,
    province_variants=dict(REGION_VARIANTS),
)
