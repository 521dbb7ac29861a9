"""Code tables and what they say about a Column: each a fixed map, looked up inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordloom.functions.text import literal_map

# Interpretation codes that are kept as they are, and the nearest word for the others.
INTERPRETATIONS = (
    "EX HM OBX CAR Carrier B D U W < > AC IE QCF TOX A N I MS NCL NS R S VS AA H L HH LL HX LX H> HU E L< LU ND IND NEG POS EXP UNE DET "
    "SYN-R NR RR WR SDD SYN-S unknown asked-unknown temp-unknown not-asked asked-declined masked not-applicable unsupported as-text error "
    "not-a-number negative-infinity positive-infinity not-performed not-permitted normal high low abnormal critical Normal High Low Abnormal Critical"
).split()
# Why a value is absent, by null flavour; those that tell of a value that is there.
ABSENT_REASONS = {
    "UNK": "unknown", "NI": "unknown", "ASKU": "asked-unknown", "NASK": "not-asked", "NAV": "temp-unknown", "NAVU": "unknown", "MSK": "masked",
    "NA": "not-applicable", "OTH": "unsupported", "NINF": "negative-infinity", "PINF": "positive-infinity",
}
PRESENT_FLAVORS = ("DER", "UNC", "QS", "TRC")
# Vital signs by LOINC code: kind, name, unit, SNOMED code.
VITALS = {
    "8480-6": ("bloodPressureSystolic", "Systolic Blood Pressure", "mmHg", "271649006"),
    "8462-4": ("bloodPressureDiastolic", "Diastolic Blood Pressure", "mmHg", "271650006"),
    "55284-4": ("bloodPressurePanel", "Blood Pressure Panel", "mmHg", "75367002"),
    "85354-9": ("bloodPressurePanel", "Blood Pressure Panel", "mmHg", "75367002"),
    "8478-0": ("meanBloodPressure", "Mean Blood Pressure", "mmHg", "6797001"),
    "8867-4": ("heartRate", "Heart Rate", "bpm", "364075005"),
    "9279-1": ("respiratoryRate", "Respiratory Rate", "breaths/min", "86290005"),
    "8310-5": ("bodyTemperature", "Body Temperature", "degC", "386725007"),
    "8331-1": ("bodyTemperatureOral", "Body Temperature (Oral)", "degC", "386725007"),
    "2708-6": ("oxygenSaturation", "Oxygen Saturation", "%", "431314004"),
    "59408-5": ("oxygenSaturation", "Oxygen Saturation (Pulse Ox)", "%", "431314004"),
    "29463-7": ("bodyWeight", "Body Weight", "kg", "27113001"),
    "8302-2": ("bodyHeight", "Body Height", "cm", "50373000"),
    "39156-5": ("bmi", "Body Mass Index", "kg/m2", "60621009"),
    "72514-3": ("painSeverity", "Pain Severity (0-10 NRS)", "{score}", "225908003"),
    "9843-4": ("headCircumference", "Head Occipital-Frontal Circumference", "cm", "363812007"),
    "8289-1": ("headCircumferencePercentile", "Head Circumference Percentile", "%", "363812007"),
    "77606-2": ("weightForLengthPercentile", "Weight-for-Length Percentile", "%", "248334005"),
    "59576-9": ("bmiPercentile", "BMI Percentile", "%", "60621009"),
    "79893-4": ("intraocularPressureRightEye", "Intraocular Pressure (Right Eye)", "mm[Hg]", "41633001"),
    "79892-6": ("intraocularPressureLeftEye", "Intraocular Pressure (Left Eye)", "mm[Hg]", "41633001"),
}
# Review statuses of variant archives, their stars, classes and kinds of submitters.
REVIEW_STATUSES = {
    "no assertion provided": "NoAssertionProvided", "no assertion criteria provided": "CriteriaNotProvided", "criteria provided, single submitter": "SingleSubmitter",
    "criteria provided, conflicting interpretations": "ConflictingSubmissions", "criteria provided, conflicting classifications": "ConflictingSubmissions",
    "criteria provided, conflicting classifications of pathogenicity": "ConflictingSubmissions",
    "criteria provided, multiple submitters, no conflicts": "MultipleSubmittersNoConflict", "reviewed by expert panel": "ExpertPanelReviewed", "practice guideline": "PracticeGuideline",
}
STARS = {
    "NoAssertionProvided": 0, "CriteriaNotProvided": 0, "SingleSubmitter": 1, "ConflictingSubmissions": 1, "MultipleSubmittersNoConflict": 2,
    "ExpertPanelReviewed": 3, "PracticeGuideline": 4,
}
CLASSES = {"pathogenic": "Pathogenic", "likely pathogenic": "LikelyPathogenic", "uncertain significance": "VUS", "likely benign": "LikelyBenign", "benign": "Benign"}
SUBMITTERS = {
    "laboratory": "SubmitterLaboratory", "resource": "SubmitterLaboratory", "consortium": "SubmitterConsortium", "expert-panel": "SubmitterExpertPanel",
    "expert panel": "SubmitterExpertPanel", "research group": "SubmitterResearch", "research": "SubmitterResearch", "clinician": "SubmitterClinician",
    "single clinician": "SubmitterClinician",
}
# Answer codes of genomic reports.
CLASS_ANSWERS = {"LA6668-3": "Pathogenic", "LA26332-9": "LikelyPathogenic", "LA26333-7": "VUS", "LA26334-5": "LikelyBenign", "LA6675-8": "Benign"}
ZYGOSITY_ANSWERS = {"LA6705-3": "Homozygous", "LA6706-1": "Heterozygous", "LA6707-9": "Hemizygous", "LA6704-6": "HomozygousReference"}
ZYGOSITY_TERMS = {"GENO:0000135": "Heterozygous", "GENO:0000136": "Homozygous", "GENO:0000134": "Hemizygous"}
CAUSALITY = {"CAUSATIVE": "Causative", "CONTRIBUTORY": "Contributory", "UNKNOWN_SIGNIFICANCE": "UncertainCausality", "REJECTED": "Rejected", "NOT_PROVIDED": "UncertainCausality"}
SEXES = {"MALE": "male", "FEMALE": "female", "OTHER_SEX": "intersex", "UNKNOWN_SEX": "intersex"}
# Parts of a genomic observation by LOINC code.
COMPONENTS = {
    "48004-6": "hgvs_c", "48005-3": "hgvs_p", "81290-9": "hgvs_g", "48018-6": "gene", "51958-7": "transcript", "48013-7": "reference_sequence", "81252-9": "variant",
    "53034-5": "zygosity", "81258-6": "allele_frequency", "82120-7": "phase", "48019-4": "change_type", "69547-8": "ref_allele", "69551-0": "alt_allele",
    "81254-5": "start_end", "48002-0": "source_class", "84414-2": "haplotype", "84413-4": "genotype", "53037-8": "significance", "81259-4": "condition", "51969-4": "report",
}
# IRI of a code system by its OID, and kinds of clinical documents by LOINC code.
SYSTEM_IRIS = {
    "2.16.840.1.113883.6.88": "http://www.nlm.nih.gov/research/umls/rxnorm/", "2.16.840.1.113883.6.96": "http://snomed.info/id/", "2.16.840.1.113883.6.1": "http://loinc.org/",
    "2.16.840.1.113883.6.90": "http://hl7.org/fhir/sid/icd-10-cm/", "2.16.840.1.113883.6.103": "http://hl7.org/fhir/sid/icd-9-cm/",
    "2.16.840.1.113883.6.12": "http://www.ama-assn.org/go/cpt/", "2.16.840.1.113883.6.285": "http://www.cms.gov/Medicare/Coding/HCPCSReleaseCodeSets/",
    "2.16.840.1.113883.6.69": "http://hl7.org/fhir/sid/ndc/", "2.16.840.1.113883.12.292": "http://hl7.org/fhir/sid/cvx/",
    "2.16.840.1.113883.12.227": "http://www.cdc.gov/vaccines/programs/vfc/cdsi/cdsi-mvx/", "2.16.840.1.113883.5.2": "http://terminology.hl7.org/CodeSystem/v3-MaritalStatus/",
    "2.16.840.1.113883.5.1": "http://terminology.hl7.org/CodeSystem/v3-AdministrativeGender/", "2.16.840.1.113883.3.26.1.1": "http://ncimeta.nci.nih.gov/",
    "2.16.840.1.113883.6.8": "http://unitsofmeasure.org/", "2.16.840.1.113883.4.6": "http://hl7.org/fhir/sid/us-npi/",
}
DOCUMENT_TYPES = {"34133-9": "summarization", "11488-4": "consultation-note", "18842-5": "discharge-summary", "11506-3": "progress-note"}
# Medication statuses by word or SNOMED code.
STATUSES = {
    "active": "active", "completed": "completed", "complete": "completed", "inactive": "completed", "stopped": "completed", "discontinued": "completed",
    "55561003": "active", "73425007": "completed", "413322009": "completed",
}


def _get(table: dict, key: Column) -> Column:
    return F.element_at(literal_map(table), key)


def interpretation(code: Column) -> Column:
    """Interpretation of a result: null for a code outside the set, ``unknown`` where none is stated."""
    return F.when(code.isNull() | (code == ""), "unknown").when(code.isin(*INTERPRETATIONS), code)


def absent_reason(flavor: Column) -> Column:
    """Reason of an absent value; null where the flavour tells of a value, ``unknown`` for flavours not known."""
    code = F.upper(F.trim(flavor))
    return F.when((code != "") & ~code.isin(*PRESENT_FLAVORS), F.coalesce(_get(ABSENT_REASONS, code), F.lit("unknown")))


def vital_sign(code: Column) -> Column:
    """Struct (kind, name, unit, snomed) of a vital sign's LOINC code; null for other codes."""
    names = ("kind", "name", "unit", "snomed")
    table = F.create_map(*[x for k, v in VITALS.items() for x in (F.lit(k), F.struct(*[F.lit(y).alias(n) for n, y in zip(names, v)]))])
    return F.element_at(table, code)


def review_status(text: Column) -> Column:
    return _get(REVIEW_STATUSES, F.lower(F.trim(text)))


def stars(status: Column) -> Column:
    """Stars (0 to 4) of a review status."""
    return _get(STARS, status)


def pathogenicity(text: Column) -> Column:
    """Class of a classification text or answer code; null for other phrasings."""
    return F.coalesce(_get(CLASSES, F.lower(F.trim(text))), _get(CLASS_ANSWERS, text))


def submitter_category(text: Column) -> Column:
    return _get(SUBMITTERS, F.lower(F.trim(text)))


def zygosity_code(code: Column) -> Column:
    return F.coalesce(_get(ZYGOSITY_ANSWERS, code), _get(ZYGOSITY_TERMS, code))


def causality(status: Column) -> Column:
    return _get(CAUSALITY, status)


def biological_sex(sex: Column) -> Column:
    return _get(SEXES, sex)


def needs_confirmation(cls: Column) -> Column:
    """Whether an interpretation must be confirmed by a laboratory."""
    return F.coalesce(cls.isin("Pathogenic", "LikelyPathogenic"), F.lit(False))


def code_iri(oid: Column, code: Column) -> Column:
    """IRI of a code by its system's OID; ``urn:oid:`` for unknown systems."""
    bare = F.regexp_replace(oid, "^urn:oid:", "")
    return F.coalesce(F.concat(_get(SYSTEM_IRIS, bare), code), F.concat(F.lit("urn:oid:"), bare, F.lit(":"), code))


def document_type(code: Column) -> Column:
    return F.coalesce(_get(DOCUMENT_TYPES, code), F.lit("other"))


def medication_status(code: Column) -> Column:
    """active, completed or unknown, by word or code."""
    return F.coalesce(_get(STATUSES, F.lower(F.trim(code))), F.lit("unknown"))


def origin_state(germline: Column, somatic: Column) -> Column:
    """Germline, Somatic or Unknown, by what a variant's observations say (both: Unknown)."""
    g, s = F.coalesce(germline, F.lit(False)), F.coalesce(somatic, F.lit(False))
    return F.when(g & ~s, "Germline").when(s & ~g, "Somatic").otherwise("Unknown")


def pedigree_role(member: Column, proband: Column, father: Column, mother: Column, sex: Column, member_father: Column, member_mother: Column) -> Column:
    """Role of a family member towards the proband; null where the family tree does not say."""
    child = (member_father == proband) | (member_mother == proband)
    sibling = (member_father == father) | (member_mother == mother)
    return (
        F.when(member == proband, "Proband").when(member == father, "FTH").when(member == mother, "MTH")
        .when(child, F.when(sex == "MALE", "SON").when(sex == "FEMALE", "DAU")).when(sibling, F.when(sex == "MALE", "BRO").when(sex == "FEMALE", "SIS"))
    )
