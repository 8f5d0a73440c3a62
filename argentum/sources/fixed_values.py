"""Names, offsets and code maps that data in these layouts relies on."""

# fixed values: logical table -> physical table, per layout
PHYSICAL_TABLES = {
    "i2b2": {
        "visit": "i2b2_visit",
        "documents": "i2b2_observation_doc",
        "patients": "i2b2_patient",
        "icd10": "i2b2_observation_cim10",
        "procedure": "i2b2_observation_ccam",
        "cost": "i2b2_observation_ghm",
        "care_site": "i2b2_observation_ufr",
        "visit_detail": "i2b2_observation_ufr",
        "biology": "i2b2_observation_lab",
    },
    "i2b2_production": {
        "visit": "i2b2_orbis_visit_dim",
        "documents": "i2b2_observation_fact_document",
        "patients": "i2b2_patient_dim",
        "icd10": "i2b2_arem_observation_fact_cim10",
        "procedure": "i2b2_arem_observation_fact_ccam",
        "cost": "i2b2_observation_fact_ghm",
        "care_site": "i2b2_observation_fact_ufr",
        "visit_detail": "i2b2_observation_fact_ufr",
        "biology": "i2b2_observation_fact_lab",
    },
    "omop": {
        "visit": "visit_occurrence",
        "documents": "note",
        "patients": "person",
        "icd10": "condition_occurrence",
        "procedure": "procedure_occurrence",
        "cost": "cost",
        "care_site": "care_site",
        "visit_detail": "visit_detail",
        "biology": "observation",
    },
}

# fixed values: physical column -> canonical column, per logical table
CANONICAL_COLUMNS = {
    "documents": {
        "instance_num": "note_id",
        "start_date": "note_datetime",
        "concept_cd": "note_class_source_value",
        "encounter_num": "visit_occurrence_id",
        "patient_num": "person_id",
        "observation_blob": "note_text",
        "provider_id": "note_title",
        "sourcesystem_cd": "cdm_source",
    },
    "patients": {
        "patient_num": "person_id",
        "birth_date": "birth_datetime",
        "death_date": "death_datetime",
        "sex_cd": "gender_source_value",
        "sourcesystem_cd": "cdm_source",
    },
    "visit": {
        "patient_num": "person_id",
        "encounter_num": "visit_occurrence_id",
        "location_cd": "care_site_id",
        "start_date": "visit_start_datetime",
        "end_date": "visit_end_datetime",
        "sourcesystem_cd": "cdm_source",
        "type_visite": "visit_source_value",
        "mode_entree": "admitted_from_source_value",
        "mode_sortie": "discharge_to_source_value",
    },
    "icd10": {
        "patient_num": "person_id",
        "encounter_num": "visit_occurrence_id",
        "instance_num": "condition_occurrence_id",
        "start_date": "condition_start_datetime",
        "concept_cd": "condition_source_value",
        "tval_char": "condition_status_source_value",
        "sourcesystem_cd": "cdm_source",
    },
    "procedure": {
        "patient_num": "person_id",
        "encounter_num": "visit_occurrence_id",
        "instance_num": "procedure_occurrence_id",
        "start_date": "procedure_start_datetime",
        "concept_cd": "procedure_source_value",
        "sourcesystem_cd": "cdm_source",
    },
    "cost": {
        "patient_num": "person_id",
        "encounter_num": "visit_occurrence_id",
        "instance_num": "drg_source_concept_id",
        "start_date": "incurred_datetime",
        "concept_cd": "concept_cd",
        "sourcesystem_cd": "cdm_source",
    },
    "care_site": {
        "location_cd": "care_site_source_value",
        "encounter_num": "visit_occurrence_id",
    },
    "visit_detail": {
        "location_cd": "care_site_id",
        "encounter_num": "visit_occurrence_id",
        "start_date": "ufr_start_datetime",
        "end_date": "ufr_end_datetime",
        "sourcesystem_cd": "cdm_source",
    },
    "biology": {
        "patient_num": "person_id",
        "encounter_num": "visit_occurrence_id",
        "instance_num": "biology_occurrence_id",
        "start_date": "biology_start_datetime",
        "concept_cd": "biology_source_value",
        "sourcesystem_cd": "cdm_source",
        "nval_num": "biology_status_source_value",
    },
}

# fixed values: (column, first character counted from 1, length) of the code inside a raw value
CODE_SLICES = {
    "icd10": ("condition_source_value", 7, 20),
    "procedure": ("procedure_source_value", 6, 20),
    "documents": ("note_class_source_value", 4, 100),
    "care_site": ("care_site_source_value", 5, 3),
    "visit_detail": ("care_site_id", 5, 20),
    "biology": ("biology_source_value", 5, 20),
}
STAY_GROUP_SLICE = (5, 20)
STAY_LETTER_SLICE = (7, 1)
UNKNOWN = "INCONNU"

# fixed values: note classes and document patterns
RCP_CLASS = "RCP"
PATHOLOGY_CLASS = "CR-ANAPATH"
TITLE_PATTERN = r"(?i)intitul[ée].*"
RCP_TITLE_PATTERN = r"rcp?"
SCANNED_MARKER = "FICHIER PDF SCAN"
SAMPLING_PATTERN = (
    r"((pr[ée]lev[ée]\sle)|(date\sd.\spr[ée]l[èe]vement))\s?:?\s{1,3}(\d{2}\/\d{2}\/\d{2,4})"
)
RECEPTION_PATTERN = r"((r?e[cç]u\sle)|(date\sde\sr.ception))\s?:?\s{1,3}(\d{2}\/\d{2}\/\d{2,4})"

# fixed values: code maps of the visit, person and condition tables
VISIT_TYPE = {"I": "Hosp", "II": "Incomp", "U": "Urg", "O": "Ext"}
SEX = {"W": "f", "M": "m"}
DIAGNOSIS_RANK = {"DP": 1, "DR": 2, "DAS": 3}
DISCHARGE_MODE = {
    "1-DOMI": "01",
    "1-CLOT": "02",
    "6-DC": "03",
    "4-MCO-INT": "04",
    "2-SSR-INT": "05",
    "3-SLD-INT": "06",
    "A-PSY-INT": "07",
    "7-MCO": "08",
    "2-SSR": "09",
    "3-SLD": "10",
    "A-PSY": "11",
    "A-HAD": "12",
    "8-TRSF-NON-SANI": "19",
    "UT1": "20",
    "UT2": "21",
    "UT3": "22",
    "UT4": "23",
    "UT5": "24",
    "UN1": "25",
    "UN2": "26",
    "UN3": "27",
    "M": "Non Renseigné",
}

# fixed values: flag columns of the surgery code list
SURGERY_FLAGS = [
    "Exerese_abdo_pelvien",
    "Exerese_ORL",
    "Exerese_thoracique",
    "Exerese_sein",
    "Exerese_estomac",
    "Exerese_foie",
    "Exerese_oesophage",
    "Exerese_pancreas",
    "Exerese_rectum",
    "Omentectomie_laparo",
    "Omentectomie_coelio",
    "Autres_resections_coelio",
]

# fixed values: masking and labelling constants
MASK = "<mask>"
ANNOTATION_CONSTANTS = {
    "label_name": "Biopsie/Cytoponction",
    "label_value": False,
    "diagnostic": "pas de diagnostic",
    "type": "biopsie",
}
