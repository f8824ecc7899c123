"""Feed layouts: table columns, candidate headers and JSON paths (fixed values)."""

REGISTRY = [
    "N_NUMBER", "SERIAL_NUMBER", "MFR", "MODEL", "ENG_MFR", "ENG_MODEL", "YEAR_MFR",
    "REGISTRANT_TYPE", "REGISTRANT_NAME", "CITY", "STATE", "CERT_ISSUE_DATE",
    "AIRWORTHINESS_CLASS", "STATUS", "MODE_S_HEX", "EXPIRATION_DATE",
]
DEREGISTERED = [
    "N_NUMBER", "SERIAL_NUMBER", "MFR", "MODEL", "ENG_MFR", "ENG_MODEL", "YEAR_MFR",
    "REGISTRANT_NAME", "CITY", "STATE", "CANCEL_DATE", "LAST_ACT_DATE", "STATUS_CODE",
]
HISTORY = ["N_NUMBER", "DATE", "EVENT", "DETAILS"]
SDR = [
    "REPORT_ID", "DATE", "N_NUMBER", "SERIAL_NUMBER", "MFR", "MODEL", "ENG_MFR", "ENG_MODEL",
    "JASC_CODE", "JASC_DESCRIPTION", "PART_NAME", "SEVERITY", "NARRATIVE", "SOURCE_YEAR",
]
NTSB = [
    "EVENT_ID", "DATE", "N_NUMBER", "SERIAL_NUMBER", "MFR", "MODEL", "OPERATOR", "CITY", "STATE",
    "AIRPORT", "HIGHEST_INJURY", "DAMAGE", "STATUS", "PROBABLE_CAUSE", "EVENT_TYPE",
    "INJURY_ONBOARD", "INJURY_ONGROUND", "HAS_SAFETY_REC", "REPORT_TYPE", "MKEY", "REPORT_URL",
    "SOURCE_MODE",
]
DIRECTIVES = [
    "AD_NUMBER", "FR_DOCUMENT_NUMBER", "TITLE", "ABSTRACT", "EFFECTIVE_DATE", "PUBLICATION_DATE",
    "RIN", "SOURCE_URL",
]
APPLICABILITY = [
    "AD_NUMBER", "APPLIES_MFR", "APPLIES_MODEL", "APPLIES_ENG_MFR", "APPLIES_ENG_MODEL",
    "APPLICABILITY_CONFIDENCE",
]
ADS = [
    "AD_NUMBER", "EFFECTIVE_DATE", "SUBJECT", "APPLIES_MFR", "APPLIES_MODEL", "APPLIES_ENG_MFR",
    "APPLIES_ENG_MODEL", "RECURRING", "COST_BAND", "NOTES",
]
ENFORCEMENT = [
    "CASE_ID", "DATE_CLOSED", "RESPONDENT", "RESPONDENT_TYPE", "ACTION", "AMOUNT", "SUMMARY",
]
ASRS = ["ACN", "DATE", "MFR", "MODEL", "AIRPORT", "THEMES", "SYNOPSIS"]
INCURSIONS = ["AIRPORT", "DATE", "SEVERITY", "DESCRIPTION"]
STRIKES = ["AIRPORT", "DATE", "SPECIES", "DAMAGE"]
AIRPORT_RISK = [
    "AIRPORT", "NAME", "RUNWAY_INCURSIONS_5YR", "WILDLIFE_STRIKES_5YR", "COASTAL", "NOTES",
]
FLIGHTS = ["N_NUMBER", "DATE", "ORIGIN", "DEST", "DURATION_MIN"]
HEALTH = [
    "source_name", "run_started_at", "run_finished_at", "status", "records_discovered",
    "records_downloaded", "records_loaded", "artifact_hash", "schema_version",
    "source_last_updated", "error_message", "confidence",
]

# logical table -> file name without extension, and its columns
TABLES = {
    "registry": ("registry", REGISTRY), "registration_history": ("registration_history", HISTORY),
    "sdr": ("sdr", SDR), "ntsb": ("ntsb", NTSB), "ads": ("ads", ADS),
    "enforcement": ("enforcement", ENFORCEMENT), "asrs": ("asrs", ASRS),
    "airport_risk": ("airport_risk", AIRPORT_RISK), "flights": ("flights", FLIGHTS),
}

# registry bundle: part -> file name (matched without regard to case)
BUNDLE = {
    "master": "MASTER.txt", "acftref": "ACFTREF.txt", "engine": "ENGINE.txt", "dereg": "DEREG.txt",
    "docindex": "DOCINDEX.txt", "dealer": "DEALER.txt", "reserved": "RESERVED.txt",
}
BUNDLE_REQUIRED = ["master", "acftref", "engine"]
BUNDLE_PASS_THROUGH = {
    "acftref": "aircraft_reference", "engine": "engine_reference", "docindex": "document_index",
    "dealer": "dealers", "reserved": "reserved_n_numbers",
}

# candidate headers in normalised form; the first one present is taken
SDR_HEADERS = {
    "REPORT_ID": ["REPORT_ID", "SDR_RECORD_ID", "CONTROL_NUMBER", "OPERATOR_CONTROL_NUMBER",
                  "SDR_NO", "DIFFICULTY_REPORT_NO", "C5"],
    "DATE": ["DATE", "DIFFICULTY_DATE", "DATE_OF_DIFFICULTY", "EVENT_DATE", "REPORT_DATE"],
    "N_NUMBER": ["N_NUMBER", "AIRCRAFT_REGISTRATION_NUMBER", "REGISTRY_N_NUMBER",
                 "REGISTRATION_NUMBER", "REGISTRATION_NO", "AIRCRAFT_REGISTRATION_NO"],
    "SERIAL_NUMBER": ["SERIAL_NUMBER", "AIRCRAFT_SERIAL_NUMBER", "ACFT_SERIAL_NO",
                      "AIRCRAFT_SERIAL_NO"],
    "MFR": ["MFR", "AIRCRAFT_MAKE", "ACFT_MAKE", "MAKE"],
    "MODEL": ["MODEL", "AIRCRAFT_MODEL", "ACFT_MODEL"],
    "ENG_MFR": ["ENG_MFR", "ENGINE_MAKE", "ENG_MAKE"],
    "ENG_MODEL": ["ENG_MODEL", "ENGINE_MODEL"],
    "JASC_CODE": ["JASC_CODE", "ATA_CODE", "ATA_JASC_CODE", "JASC"],
    "JASC_DESCRIPTION": ["JASC_DESCRIPTION", "ATA_DESCRIPTION", "JASC_DESC"],
    "PART_NAME": ["PART_NAME", "COMPONENT_NAME", "PART"],
    "SEVERITY": ["SEVERITY", "PRECAUTIONARY_PROCEDURE", "STAGE_OF_OPERATION"],
    "NARRATIVE": ["NARRATIVE", "DISCREPANCY", "REMARKS", "TEXT", "DIFFICULTY_DESCRIPTION",
                  "PROBLEM_DESCRIPTION"],
}
SDR_ESSENTIAL = ["DATE", "MFR", "MODEL"]
FIRST_YEAR = 1995

NTSB_HEADERS = {
    "EVENT_ID": ["EVENT_ID", "NTSB_NO", "NTSBNO", "NTSB_NUMBER", "EV_ID", "MKEY"],
    "DATE": ["DATE", "EVENT_DATE", "EV_DATE"],
    "N_NUMBER": ["N_NUMBER", "REGISTRATION_NUMBER", "REGIST_NO", "REGISTRATION"],
    "SERIAL_NUMBER": ["SERIAL_NUMBER", "ACFT_SERIAL_NO"],
    "MFR": ["MFR", "MAKE", "ACFT_MAKE", "AIRCRAFT_MAKE"],
    "MODEL": ["MODEL", "ACFT_MODEL", "AIRCRAFT_MODEL"],
    "OPERATOR": ["OPERATOR", "OPERATOR_NAME", "OPER_NAME"],
    "CITY": ["CITY", "EV_CITY", "LOCATION_CITY"],
    "STATE": ["STATE", "EV_STATE", "LOCATION_STATE"],
    "AIRPORT": ["AIRPORT", "AIRPORT_CODE", "EV_AIRPORT", "AIRPORT_ID"],
    "HIGHEST_INJURY": ["HIGHEST_INJURY", "EV_HIGHEST_INJURY", "HIGHEST_INJURY_LEVEL",
                       "INJURY_SEVERITY"],
    "DAMAGE": ["DAMAGE", "DAMAGE_LEVEL", "ACFT_DAMAGE", "AIRCRAFT_DAMAGE"],
    "STATUS": ["STATUS", "REPORT_STATUS", "COMPLETION_STATUS"],
    "PROBABLE_CAUSE": ["PROBABLE_CAUSE", "CM_PROBABLECAUSE", "PROBABLE_CAUSE_TEXT", "CAUSE"],
}
NTSB_ESSENTIAL = ["EVENT_ID", "DATE"]

# candidate JSON paths; the first non-blank one is taken
NTSB_PATHS = {
    "EVENT_ID": ["cm_ntsbNum", "ntsbNumber", "NtsbNumber", "cm_mkey", "ev_id"],
    "DATE": ["cm_eventDate", "eventDate", "EventDate", "ev_date"],
    "N_NUMBER": ["cm_vehicles.0.registrationNumber", "vehicles.0.registrationNumber",
                 "RegistrationNumber", "registration"],
    "SERIAL_NUMBER": ["cm_vehicles.0.serialNumber", "vehicles.0.serialNumber", "SerialNumber"],
    "MFR": ["cm_vehicles.0.make", "vehicles.0.make", "Make"],
    "MODEL": ["cm_vehicles.0.model", "vehicles.0.model", "Model"],
    "OPERATOR": ["cm_vehicles.0.operatorName", "vehicles.0.operatorName", "OperatorName",
                 "operator"],
    "CITY": ["cm_city", "city", "City"],
    "STATE": ["cm_state", "state", "State"],
    "AIRPORT": ["cm_airportId", "airportId", "AirportID"],
    "HIGHEST_INJURY": ["cm_highestInjury", "highestInjury", "HighestInjuryLevel"],
    "DAMAGE": ["cm_vehicles.0.damageLevel", "vehicles.0.damageLevel", "DamageLevel", "damage"],
    "STATUS": ["cm_completionStatus", "completionStatus", "Status"],
    "PROBABLE_CAUSE": ["cm_probableCause", "probableCause", "ProbableCause"],
}
# entity-attribute-value exports: field name -> column
EAV_FIELDS = {
    "NtsbNo": "EVENT_ID", "EventDate": "DATE", "N#": "N_NUMBER", "VehicleMake": "MFR",
    "VehicleModel": "MODEL", "City": "CITY", "State": "STATE",
    "HighestInjuryLevel": "HIGHEST_INJURY", "CompletionStatus": "STATUS",
    "EventType": "EVENT_TYPE", "Mkey": "MKEY", "InjuryOnboardCount": "INJURY_ONBOARD",
    "InjuryOngroundCount": "INJURY_ONGROUND", "HasSafetyRec": "HAS_SAFETY_REC",
    "MostRecentReportType": "REPORT_TYPE",
}
REPORT_URL_PREFIX = (
    "https://data.ntsb.gov/carol-repgen/api/Aviation/ReportMain/GenerateNewestReport/")

ENFORCEMENT_HEADERS = {
    "CASE_ID": ["CASE_ID", "CASE_NUMBER", "CASE_NO", "EIR_NUMBER"],
    "DATE_CLOSED": ["DATE_CLOSED", "CLOSED_DATE", "CLOSURE_DATE", "DATE"],
    "RESPONDENT": ["RESPONDENT", "RESPONDENT_NAME", "ENTITY", "NAME"],
    "RESPONDENT_TYPE": ["RESPONDENT_TYPE", "ENTITY_TYPE", "TYPE"],
    "ACTION": ["ACTION", "ACTION_TYPE", "SANCTION", "DISPOSITION"],
    "AMOUNT": ["AMOUNT", "CIVIL_PENALTY", "PENALTY_AMOUNT", "PENALTY"],
    "SUMMARY": ["SUMMARY", "DESCRIPTION", "NARRATIVE", "VIOLATION", "REMARKS"],
}
ENFORCEMENT_ESSENTIAL = ["RESPONDENT", "ACTION"]
ASRS_HEADERS = {
    "ACN": ["ACN", "ACCESSION_NUMBER", "REPORT_NUMBER", "ACN_NUMBER"],
    "DATE": ["DATE", "TIME_DATE", "REPORT_DATE", "EVENT_DATE"],
    "MFR": ["MFR", "MAKE", "AIRCRAFT_MAKE", "ACFT_MAKE", "AIRCRAFT_MAKE_MODEL"],
    "MODEL": ["MODEL", "AIRCRAFT_MODEL", "ACFT_MODEL"],
    "AIRPORT": ["AIRPORT", "LOCALE_REFERENCE", "AIRPORT_CODE", "LOCATION"],
    "THEMES": ["THEMES", "HUMAN_FACTORS", "CONTRIBUTING_FACTORS", "ANOMALY", "FACTORS"],
    "SYNOPSIS": ["SYNOPSIS", "NARRATIVE", "REPORT_NARRATIVE", "SUMMARY"],
}
ASRS_ESSENTIAL = ["ACN"]
INCURSION_HEADERS = {
    "AIRPORT": ["AIRPORT", "AIRPORT_ID", "AIRPORT_CODE", "LOCATION_ID", "FACILITY", "LOCID"],
    "DATE": ["DATE", "EVENT_DATE", "INCIDENT_DATE", "LOCAL_DATE", "OCCURRENCE_DATE"],
    "SEVERITY": ["SEVERITY", "CATEGORY", "RI_CATEGORY", "CLASSIFICATION"],
    "DESCRIPTION": ["DESCRIPTION", "NARRATIVE", "REMARKS", "SUMMARY"],
}
STRIKE_HEADERS = {
    "AIRPORT": ["AIRPORT", "AIRPORT_ID", "AIRPORT_CODE", "LOCATION_ID", "FAAID"],
    "DATE": ["DATE", "INCIDENT_DATE", "EVENT_DATE", "STRIKE_DATE"],
    "SPECIES": ["SPECIES", "SPECIES_NAME", "SPECIES_ID"],
    "DAMAGE": ["DAMAGE", "INDICATED_DAMAGE", "DAMAGE_LEVEL", "AIRCRAFT_DAMAGE"],
}
AIRPORT_ESSENTIAL = ["AIRPORT"]
