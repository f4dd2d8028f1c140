"""Small dimensions that come with the library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Codes of document types with their Polish and English names, usual owners and formats, and whether a template is provided.
DOCUMENT_TYPES = (
    ("POLICY", "Polityka", "Policy", "CISO / CTO / MGR", "Markdown / PDF", True),
    ("STANDARD", "Standard", "Standard", "ARCH / SEC", "Markdown / PDF", True),
    ("PROCEDURE", "Procedura", "Procedure", "OPS / DEVOPS", "Markdown", True),
    ("RUNBOOK", "Runbook operacyjny", "Runbook", "SRE / OPS", "Markdown", True),
    ("PLAYBOOK", "Playbook", "Playbook", "SRE / SEC", "Markdown", True),
    ("CHECKLIST", "Checklista", "Checklist", "QA / OPS", "Markdown", True),
    ("SPEC", "Specyfikacja", "Specification", "BA / DEV", "Markdown", True),
    ("ADR", "Decyzja architektoniczna", "Architecture Decision Record", "ARCH / SA", "Markdown", True),
    ("DESIGN", "Dokument projektowy", "Design Document", "ARCH / DEV", "Markdown / Diagram", True),
    ("REPORT", "Raport", "Report", "PM / BA / MGR", "Markdown / PDF", True),
    ("PLAN", "Plan", "Plan", "PM / PO", "Markdown", True),
    ("GUIDE", "Przewodnik", "Guide", "DEVOPS / TRAIN", "Markdown", True),
    ("MATRIX", "Matryca", "Matrix", "PM / BA", "Markdown / Tabela", True),
    ("REGISTER", "Rejestr", "Register", "PM / RISK / MGR", "Markdown / Tabela", True),
    ("CONTRACT", "Umowa / SLA", "Contract / SLA", "LEGAL / VENDOR", "PDF", False),
    ("ASSESSMENT", "Ocena / Assessment", "Assessment", "SEC / AUDIT / RISK", "Markdown / PDF", True),
    ("POSTMORTEM", "Postmortem", "Postmortem", "SRE / DEV", "Markdown", True),
    ("RFC", "Wniosek o zmianę", "Request for Change", "CHANGE / MGR", "Markdown / Form", True),
    ("ONBOARDING", "Dokumentacja wdrożeniowa", "Onboarding Documentation", "TRAIN / MGR", "Markdown", True),
    ("ARCHITECTURE", "Dokument architektoniczny", "Architecture Document", "ARCH / EA", "Markdown / Diagram", True),
)
#: Public titles of the controls of ISO/IEC 27001:2022, annex A, by theme, and of the categories of NIST CSF 2.0, by function.
ISO_CONTROLS = {
    ("Organizational", "A.5"): (
        "Policies for information security", "Information security roles and responsibilities", "Segregation of duties", "Management responsibilities", "Contact with authorities",
        "Contact with special interest groups", "Threat intelligence", "Information security in project management", "Inventory of information and other associated assets",
        "Acceptable use of information and other associated assets", "Return of assets", "Classification of information", "Labelling of information", "Information transfer", "Access control",
        "Identity management", "Authentication information", "Access rights", "Information security in supplier relationships", "Addressing information security within supplier agreements",
        "Managing information security in the ICT supply chain", "Monitoring, review and change management of supplier services", "Information security for use of cloud services",
        "Information security incident management planning and preparation", "Assessment and decision on information security events", "Response to information security incidents",
        "Learning from information security incidents", "Collection of evidence", "Information security during disruption", "ICT readiness for business continuity",
        "Legal, statutory, regulatory and contractual requirements", "Intellectual property rights", "Protection of records", "Privacy and protection of PII",
        "Independent review of information security", "Compliance with policies, rules and standards for information security", "Documented operating procedures",
    ),
    ("People", "A.6"): (
        "Screening", "Terms and conditions of employment", "Information security awareness, education and training", "Disciplinary process",
        "Responsibilities after termination or change of employment", "Confidentiality or non-disclosure agreements", "Remote working", "Information security event reporting",
    ),
    ("Physical", "A.7"): (
        "Physical security perimeters", "Physical entry", "Securing offices, rooms and facilities", "Physical security monitoring", "Protecting against physical and environmental threats",
        "Working in secure areas", "Clear desk and clear screen", "Equipment siting and protection", "Security of assets off-premises", "Storage media", "Supporting utilities", "Cabling security",
        "Equipment maintenance", "Secure disposal or re-use of equipment",
    ),
    ("Technological", "A.8"): (
        "User endpoint devices", "Privileged access rights", "Information access restriction", "Access to source code", "Secure authentication", "Capacity management", "Protection against malware",
        "Management of technical vulnerabilities", "Configuration management", "Information deletion", "Data masking", "Data leakage prevention", "Information backup",
        "Redundancy of information processing facilities", "Logging", "Monitoring activities", "Clock synchronization", "Use of privileged utility programs",
        "Installation of software on operational systems", "Networks security", "Security of network services", "Segregation of networks", "Web filtering", "Use of cryptography",
        "Secure development life cycle", "Application security requirements", "Secure system architecture and engineering principles", "Secure coding", "Security testing in development and acceptance",
        "Outsourced development", "Separation of development, test and production environments", "Change management", "Test information", "Protection of information systems during audit testing",
    ),
}
CSF_CATEGORIES = {
    "GOVERN": (("GV.OC", "Organizational Context"), ("GV.RM", "Risk Management Strategy"), ("GV.RR", "Roles, Responsibilities, and Authorities"), ("GV.PO", "Policy"), ("GV.OV", "Oversight"), ("GV.SC", "Cybersecurity Supply Chain Risk Management")),
    "IDENTIFY": (("ID.AM", "Asset Management"), ("ID.RA", "Risk Assessment"), ("ID.IM", "Improvement")),
    "PROTECT": (("PR.AA", "Identity Management, Authentication, and Access Control"), ("PR.AT", "Awareness and Training"), ("PR.DS", "Data Security"), ("PR.PS", "Platform Security"), ("PR.IR", "Technology Infrastructure Resilience")),
    "DETECT": (("DE.CM", "Continuous Monitoring"), ("DE.AE", "Adverse Event Analysis")),
    "RESPOND": (("RS.MA", "Incident Management"), ("RS.AN", "Incident Analysis"), ("RS.CO", "Incident Response Reporting and Communication"), ("RS.MI", "Incident Mitigation")),
    "RECOVER": (("RC.RP", "Incident Recovery Plan Execution"), ("RC.CO", "Incident Recovery Communication")),
}
#: Our own catalogue of what standards ask for: item, title, required, category, type of document, words.
CATALOGUE = {
    "ISO/IEC 27001": (
        ("4.3", "Scope of the information security management system", True, "governance", "POLICY", "isms scope"),
        ("5.2", "Information security policy", True, "governance", "POLICY", "isms policy"),
        ("6.1.2", "Information security risk assessment process", True, "risk", "PROCEDURE", "risk assessment"),
        ("6.1.3", "Statement of applicability", True, "risk", "REGISTER", "controls soa"),
        ("9.2", "Internal audit programme", True, "audit", "PLAN", "internal audit"),
        ("10.2", "Nonconformity and corrective action log", False, "audit", "REGISTER", "corrective action"),
    ),
    "ISO 22301": (
        ("8.2", "Business impact analysis", True, "continuity", "ASSESSMENT", "bia impact"),
        ("8.4", "Business continuity plan", True, "continuity", "PLAN", "bcp continuity"),
        ("8.5", "Continuity exercise programme", False, "continuity", "PLAN", "exercise test"),
    ),
    "ISO/IEC 20000-1": (
        ("8.2.4", "Service catalogue", True, "service", "REGISTER", "service catalogue"),
        ("8.3.3", "Service level agreement", True, "service", "CONTRACT", "sla level"),
        ("8.6.1", "Incident management procedure", True, "service", "PROCEDURE", "incident"),
        ("8.5.1", "Change management procedure", True, "service", "PROCEDURE", "change"),
    ),
    "GDPR": (
        ("30", "Records of processing activities", True, "privacy", "REGISTER", "processing records"),
        ("33", "Personal data breach notification procedure", True, "privacy", "PROCEDURE", "breach notification"),
        ("35", "Data protection impact assessment", True, "privacy", "ASSESSMENT", "dpia impact"),
    ),
    "NIST CSF 2.0": (
        ("GV.PO", "Cybersecurity policy", True, "governance", "POLICY", "policy"),
        ("ID.AM", "Asset inventory", True, "assets", "REGISTER", "asset inventory"),
        ("RS.MA", "Incident response plan", True, "incident", "PLAN", "incident response"),
        ("RC.RP", "Incident recovery plan", False, "incident", "PLAN", "recovery"),
    ),
    "DORA": (
        ("6", "Digital operational resilience framework", True, "risk", "POLICY", "resilience"),
        ("28", "Register of information on third-party providers", True, "suppliers", "REGISTER", "third party register"),
    ),
}
#: Names of industries by ISIC division.
ISIC = {
    "01": "Crop and animal production, hunting and related services",
    "02": "Forestry and logging",
    "05": "Mining of coal and lignite",
    "06": "Extraction of crude petroleum and natural gas",
    "07": "Mining of metal ores",
    "09": "Mining support service activities",
    "10": "Manufacture of food products",
    "14": "Manufacture of wearing apparel",
    "16": "Manufacture of wood products",
    "18": "Printing and reproduction of recorded media",
    "21": "Manufacture of pharmaceuticals",
    "23": "Manufacture of non-metallic mineral products",
    "25": "Manufacture of fabricated metal products",
    "26": "Manufacture of computer, electronic and optical products",
    "28": "Manufacture of machinery and equipment",
    "33": "Repair and installation of machinery and equipment",
    "35": "Electricity, gas, steam and air conditioning supply",
    "36": "Water collection, treatment and supply",
    "38": "Waste collection, treatment and disposal; materials recovery",
    "39": "Remediation and other waste management services",
    "41": "Construction of buildings",
    "42": "Civil engineering",
    "45": "Motor vehicles trade and repair",
    "47": "Retail trade",
    "49": "Land transport and transport via pipelines",
    "50": "Water transport",
    "51": "Air transport",
    "52": "Warehousing and support for transportation",
    "55": "Accommodation",
    "56": "Food and beverage service activities",
    "58": "Publishing activities",
    "59": "Film, video, TV production; music publishing",
    "60": "Programming and broadcasting activities",
    "61": "Telecommunications",
    "62": "Computer programming, consultancy and related activities",
    "63": "Information service activities",
    "64": "Financial service activities (except insurance/pensions)",
    "65": "Insurance and pension funding",
    "66": "Auxiliary finance and insurance activities",
    "68": "Real estate activities",
    "69": "Legal and accounting activities",
    "70": "Head offices; management consultancy",
    "71": "Architectural/engineering; technical testing/analysis",
    "72": "Scientific research and development",
    "73": "Advertising and market research",
    "78": "Employment activities",
    "79": "Travel agency, tour operator services",
    "80": "Security and investigation activities",
    "82": "Office/admin and other business support",
    "84": "Public administration and defence; social security",
    "85": "Education",
    "86": "Human health activities",
    "88": "Social work activities",
    "91": "Libraries, archives, museums, cultural activities",
    "93": "Sports, amusement and recreation activities",
    "94": "Activities of membership organisations",
    "95": "Repair of computers and personal/household goods",
    "98": "Undifferentiated household production for own use",
}
#: Standards, and regulations, that a section brings by its normalised heading.
SECTION_STANDARDS = {
    "faza 1: koncepcja i wizja": ("ISO 20000-1", "PMBOK 7", "PRINCE2 7", "TOGAF ADM"),
    "faza 2: analiza wymagan": ("IEEE 830", "ISO/IEC 12207", "PMBOK 7"),
    "faza 3: projekt / design": ("IEEE 1016", "IEEE 42010", "TOGAF ADM"),
    "faza 4: planowanie": ("PMBOK 7", "PRINCE2 7", "SAFe 6.0", "ISO 20000-1"),
    "faza 5: implementacja": ("ISO/IEC 12207", "SAFe 6.0", "SCRUM Guide"),
    "faza 6: testowanie / qa": ("IEEE 829", "ISO/IEC 12207", "OWASP ASVS"),
    "faza 7: bezpieczenstwo / compliance": ("ISO/IEC 27001", "ISO/IEC 27002", "NIS2", "DORA", "CIS Controls v8", "OWASP ASVS"),
    "faza 8: wdrozenie / deployment": ("ISO 20000-1", "ITIL 4", "ISO/IEC 27001"),
    "faza 9: operacje / maintenance": ("ITIL 4", "ISO 20000-1", "ISO/IEC 27001"),
    "faza 10: incident management": ("ITIL 4", "ISO 20000-1", "NIST CSF", "ISO 22301"),
    "faza 11: monitoring / observability": ("ITIL 4", "ISO 20000-1", "NIST SP 800-53"),
    "faza 12: dokumentacja referencyjna": ("ISO/IEC 12207", "IEEE 1016", "ISO 20000-1"),
    "faza 13: szkolenie / onboarding": ("ISO 20000-1", "ITIL 4"),
    "faza 14: komunikacja stakeholders": ("PMBOK 7", "PRINCE2 7"),
    "faza 15: knowledge management": ("ITIL 4", "ISO 20000-1"),
    "faza 16: postmortem / retrospektywa": ("ITIL 4", "SCRUM Guide", "PMBOK 7"),
    "faza 17: budzetowanie / cost management": ("COBIT 2019", "PMBOK 7", "ISO/IEC 38500"),
    "faza 18: vendor management": ("ISO 20000-1", "ISO/IEC 38500", "COBIT 2019"),
    "faza 19: governance / compliance": ("COBIT 2019", "ISO/IEC 38500", "ISO/IEC 27001", "ITIL 4"),
    "faza 20: decommission / sunset": ("ISO 20000-1", "ISO/IEC 27001", "COBIT 2019"),
    "faza 21: dr / bcp": ("ISO 22301", "NIST CSF", "ITIL 4", "ISO/IEC 27001"),
    "faza 22: change management": ("ITIL 4", "ISO 20000-1", "COBIT 2019"),
    "faza 23: capacity planning": ("ITIL 4", "ISO 20000-1", "COBIT 2019"),
    "raci i role": ("COBIT 2019", "ITIL 4", "PMBOK 7"),
    "standardy i compliance": ("ISO/IEC 27001", "ISO 9001", "COBIT 2019", "ITIL 4"),
}
SECTION_REGULATIONS = {
    "faza 7: bezpieczenstwo / compliance": ("KSC-PL", "UODO-PL", "CERT-PL-WYTYCZNE"),
    "faza 19: governance / compliance": ("KSC-PL", "UODO-PL", "PZP-PL"),
    "standardy i compliance": ("KSC-PL", "UODO-PL"),
    "raci i role": ("UODO-PL",),
    "faza 21: dr / bcp": ("KSC-PL", "UŚUDE-PL"),
}


def document_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DOCUMENT_TYPES, "type_code string, name_pl string, name_en string, typical_owner string, typical_format string, has_template boolean")


def industries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ISIC.items()), "code string, name string")


def section_codes(spark: SparkSession, regulations: bool = False) -> DataFrame:
    """section_norm, seq and the code: standards, or regulations."""
    of = SECTION_REGULATIONS if regulations else SECTION_STANDARDS
    rows = [(s, i, c) for s, codes in of.items() for i, c in enumerate(codes)]
    return spark.createDataFrame(rows, f"section_norm string, seq int, {'regulation' if regulations else 'standard'}_code string")


def control_rows() -> list[tuple[str, int, str, str, str]]:
    """standard_code, seq, control_id, title, theme of the controls of two public standards."""
    iso = [(f"{prefix}.{i}", title, theme) for (theme, prefix), titles in ISO_CONTROLS.items() for i, title in enumerate(titles, 1)]
    csf = [(code, title, function) for function, pairs in CSF_CATEGORIES.items() for code, title in pairs]
    return [(name, seq, *row) for name, rows in (("ISO/IEC 27001", iso), ("NIST CSF 2.0", csf)) for seq, row in enumerate(rows)]


def catalogue(spark: SparkSession) -> DataFrame:
    """standard_code and the six fields of each entry; is_required is 0 or 1, as tables have it."""
    rows = [(code, item, title, int(required), category, kind, words) for code, entries in CATALOGUE.items() for item, title, required, category, kind, words in entries]
    return spark.createDataFrame(rows, "standard_code string, item_code string, title string, is_required int, category string, type_code string, keywords string")
