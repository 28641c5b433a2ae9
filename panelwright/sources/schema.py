"""Fixed landing schemas and the header gate."""

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

PROVENANCE = ("SOURCE_RELEASE", "SOURCE_FILE", "SOURCE_ROW_NUMBER")


@dataclass(frozen=True)
class TableSpec:
    """Columns of a landed table, the ones it cannot do without, and known odd headers."""

    columns: tuple[str, ...]
    required: frozenset[str]
    aliases: dict[str, str] = field(default_factory=dict)


# Columns of the main table, in landed order.
MAIN_COLUMNS = tuple(
    """
    CASE_NUMBER CASE_STATUS RECEIVED_DATE DECISION_DATE ORIGINAL_CERT_DATE VISA_CLASS JOB_TITLE
    SOC_CODE SOC_TITLE FULL_TIME_POSITION BEGIN_DATE END_DATE TOTAL_WORKER_POSITIONS NEW_EMPLOYMENT
    CONTINUED_EMPLOYMENT CHANGE_PREVIOUS_EMPLOYMENT NEW_CONCURRENT_EMPLOYMENT CHANGE_EMPLOYER
    AMENDED_PETITION EMPLOYER_NAME TRADE_NAME_DBA EMPLOYER_ADDRESS1 EMPLOYER_ADDRESS2 EMPLOYER_CITY
    EMPLOYER_STATE EMPLOYER_POSTAL_CODE EMPLOYER_COUNTRY EMPLOYER_PROVINCE EMPLOYER_PHONE
    EMPLOYER_PHONE_EXT NAICS_CODE EMPLOYER_POC_LAST_NAME EMPLOYER_POC_FIRST_NAME
    EMPLOYER_POC_MIDDLE_NAME EMPLOYER_POC_JOB_TITLE EMPLOYER_POC_ADDRESS1 EMPLOYER_POC_ADDRESS2
    EMPLOYER_POC_CITY EMPLOYER_POC_STATE EMPLOYER_POC_POSTAL_CODE EMPLOYER_POC_COUNTRY
    EMPLOYER_POC_PROVINCE EMPLOYER_POC_PHONE EMPLOYER_POC_PHONE_EXT EMPLOYER_POC_EMAIL
    AGENT_REPRESENTING_EMPLOYER AGENT_ATTORNEY_LAST_NAME AGENT_ATTORNEY_FIRST_NAME
    AGENT_ATTORNEY_MIDDLE_NAME AGENT_ATTORNEY_ADDRESS1 AGENT_ATTORNEY_ADDRESS2 AGENT_ATTORNEY_CITY
    AGENT_ATTORNEY_STATE AGENT_ATTORNEY_POSTAL_CODE AGENT_ATTORNEY_COUNTRY AGENT_ATTORNEY_PROVINCE
    AGENT_ATTORNEY_PHONE AGENT_ATTORNEY_PHONE_EXT AGENT_ATTORNEY_EMAIL_ADDRESS
    LAWFIRM_NAME_BUSINESS_NAME STATE_OF_HIGHEST_COURT NAME_OF_HIGHEST_STATE_COURT WORKSITE_WORKERS
    SECONDARY_ENTITY SECONDARY_ENTITY_BUSINESS_NAME WORKSITE_ADDRESS1 WORKSITE_ADDRESS2
    WORKSITE_CITY WORKSITE_COUNTY WORKSITE_STATE WORKSITE_POSTAL_CODE WAGE_RATE_OF_PAY_FROM
    WAGE_RATE_OF_PAY_TO WAGE_UNIT_OF_PAY PREVAILING_WAGE PW_UNIT_OF_PAY PW_TRACKING_NUMBER
    PW_WAGE_LEVEL PW_OES_YEAR PW_OTHER_SOURCE PW_OTHER_YEAR PW_SURVEY_PUBLISHER PW_SURVEY_NAME
    TOTAL_WORKSITE_LOCATIONS AGREE_TO_LC_STATEMENT H_1B_DEPENDENT WILLFUL_VIOLATOR SUPPORT_H1B
    STATUTORY_BASIS APPENDIX_A_ATTACHED PUBLIC_DISCLOSURE PREPARER_LAST_NAME PREPARER_FIRST_NAME
    PREPARER_MIDDLE_INITIAL PREPARER_BUSINESS_NAME PREPARER_EMAIL EMPLOYER_FEIN
    LAWFIRM_BUSINESS_FEIN
    """.split()
)

# Columns of the worksites table, in landed order.
WORKSITE_COLUMNS = tuple(
    """
    CASE_NUMBER WORKSITE_WORKERS SECONDARY_ENTITY SECONDARY_ENTITY_BUSINESS_NAME WORKSITE_ADDRESS1
    WORKSITE_ADDRESS2 WORKSITE_CITY WORKSITE_COUNTY WORKSITE_STATE WORKSITE_POSTAL_CODE
    WAGE_RATE_OF_PAY_FROM WAGE_RATE_OF_PAY_TO WAGE_UNIT_OF_PAY PREVAILING_WAGE PW_UNIT_OF_PAY
    PW_TRACKING_NUMBER PW_WAGE_LEVEL PW_OES_YEAR PW_OTHER_SOURCE PW_OTHER_YEAR PW_SURVEY_PUBLISHER
    PW_SURVEY_NAME
    """.split()
)

# Columns a landed file must carry.
MAIN_REQUIRED = frozenset(
    """
    CASE_NUMBER CASE_STATUS DECISION_DATE RECEIVED_DATE ORIGINAL_CERT_DATE VISA_CLASS EMPLOYER_NAME
    SOC_CODE WORKSITE_CITY WORKSITE_STATE WORKSITE_POSTAL_CODE
    """.split()
)
WORKSITE_REQUIRED = frozenset(
    "CASE_NUMBER WORKSITE_CITY WORKSITE_STATE WORKSITE_POSTAL_CODE WORKSITE_WORKERS".split()
)

ALIASES = {"H-1B_DEPENDENT": "H_1B_DEPENDENT"}
SPECS = {
    "main": TableSpec(MAIN_COLUMNS, MAIN_REQUIRED, ALIASES),
    "worksites": TableSpec(WORKSITE_COLUMNS, WORKSITE_REQUIRED, ALIASES),
}


def canonical_header(header: str, aliases: dict[str, str]) -> str:
    name = header.strip().upper()
    return aliases.get(name) or re.sub(r"[\s_-]+", "_", name)


def validate_headers(headers: Sequence[str | None], spec: TableSpec, source: str = "release") -> dict[str, str]:
    """Landed header to fixed column, or an error naming what is wrong; no rows are read."""
    if any(not header for header in headers):
        raise ValueError(f"Blank header in {source}")
    if len(set(headers)) != len(headers):
        raise ValueError(f"Duplicate headers in {source}")
    clashing = sorted(set(headers) & set(PROVENANCE))
    if clashing:
        raise ValueError(f"Headers reserved for provenance in {source}: {', '.join(clashing)}")
    mapping = {header: canonical_header(header, spec.aliases) for header in headers}
    unknown = sorted(set(mapping.values()) - set(spec.columns))
    if unknown:
        raise ValueError(f"Unknown columns in {source}: {', '.join(unknown)}")
    if len(set(mapping.values())) != len(mapping):
        raise ValueError(f"Headers map to the same column in {source}")
    missing = sorted(spec.required - set(mapping.values()))
    if missing:
        raise ValueError(f"Missing required headers in {source}: {', '.join(missing)}")
    return mapping
