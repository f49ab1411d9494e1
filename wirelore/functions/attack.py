"""Alert text to risk and ATT&CK labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import bound, first_rule

# Alert fragment, tactic, technique; the first fragment found wins.
SIGNATURES = [
    ("SCAN", "Discovery", "T1046"),
    ("Portscan", "Discovery", "T1046"),
    ("NMAP", "Discovery", "T1046"),
    ("Fingerprint", "Discovery", "T1595"),
    ("INDICATOR-SCAN", "Discovery", "T1046"),
    ("C2", "Command and Control", "T1071"),
    ("Beacon", "Command and Control", "T1071"),
    ("Reverse Shell", "Command and Control", "T1059"),
    ("Metasploit", "Command and Control", "T1071"),
    ("Cobalt Strike", "Command and Control", "T1071"),
    ("INDICATOR-COMPROMISE", "Command and Control", "T1071"),
    ("Exfiltration", "Exfiltration", "T1041"),
    ("Sensitive Data", "Exfiltration", "T1041"),
    ("Data Leak", "Exfiltration", "T1041"),
    ("Lateral Movement", "Lateral Movement", "T1210"),
    ("SMB", "Lateral Movement", "T1021.002"),
    ("RDP", "Lateral Movement", "T1021.001"),
    ("Pass-the-hash", "Lateral Movement", "T1550.002"),
    ("Exploit", "Execution", "T1203"),
    ("CVE-", "Execution", "T1211"),
    ("Overflow", "Execution", "T1212"),
    ("Injection", "Execution", "T1059"),
    ("Shellcode", "Execution", "T1059"),
    ("Brute Force", "Credential Access", "T1110"),
    ("Password Spraying", "Credential Access", "T1110.003"),
    ("Credential", "Credential Access", "T1552"),
    ("Malware", "Command and Control", "T1071"),
    ("CNC", "Command and Control", "T1071"),
    ("Trojan", "Impact", "T1485"),
    ("SQL", "Initial Access", "T1190"),
    ("Webapp", "Initial Access", "T1190"),
    ("robots.txt", "Discovery", "T1595"),
    ("SERVER-WEBAPP", "Initial Access", "T1190"),
    ("PROTOCOL-DNS", "Discovery", "T1046"),
]

# Short alert labels used in fused sightings.
FUSION_LABELS = [
    (("%scan%", "%nmap%"), "Discovery (T1046)"),
    (("%c2%", "%beacon%"), "Command and Control (T1071)"),
    (("%exploit%", "%cve-%"), "Execution (T1203)"),
    (("%brute%force%",), "Credential Access (T1110)"),
]

UNMATCHED_LABEL = "General/Unknown"


def signature_mapping(message: Column) -> Column:
    """struct(tactic, technique) of an alert message."""
    def pair(tactic: str, technique: str) -> Column:
        return F.struct(F.lit(tactic).alias("tactic"), F.lit(technique).alias("technique"))

    rules = [(message.rlike(f"(?i){frag}"), pair(tactic, tech)) for frag, tactic, tech in SIGNATURES]
    return first_rule(message, rules, pair("Unknown", "None"))


def signature_label(message: Column) -> Column:
    """``Tactic (Txxxx)`` label; NULL stays NULL."""
    def label(lowered: Column) -> Column:
        rules = [(lowered.contains(frag.lower()), F.lit(f"{tactic} ({tech})")) for frag, tactic, tech in SIGNATURES]
        rules.append((lowered.isNotNull(), F.lit(UNMATCHED_LABEL)))
        return first_rule(lowered, rules)

    return bound(F.lower(message), label)  # a long text is lowered once, not once per fragment


def fusion_label(message: Column) -> Column:
    """The coarser label attached to fused sightings."""
    rules = []
    for patterns, label in FUSION_LABELS:
        hit = F.lit(False)
        for pattern in patterns:
            hit = hit | message.ilike(pattern)
        rules.append((hit, F.lit(label)))
    rules.append((message.isNotNull(), F.lit(UNMATCHED_LABEL)))
    return first_rule(message, rules)


def priority_risk(priority: Column) -> Column:
    """IDS priority to a risk score: 1 is 90, 2 is 60, other numbers 30, no number 10."""
    number = priority.try_cast("int")
    return F.when(number.isNull(), 10).when(number == 1, 90).when(number == 2, 60).otherwise(30)


def severity_badge(confidence: Column) -> Column:
    """R11."""
    return F.when(confidence >= 0.7, "high").when(confidence >= 0.4, "medium").otherwise("low")
