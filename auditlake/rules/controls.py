"""Control catalogues: (framework, control, name, detector ids)."""

# Controls and the rule ids that fail them.
SOC2 = [
    ("SOC2", "CC6.1", "Access Control", ["SOL-001", "SOL-003", "SOL-007", "SOL-010"]),
    ("SOC2", "CC6.2", "Authorization", ["SOL-005", "SOL-011", "SOL-031"]),
    ("SOC2", "CC6.3", "Input Validation", ["SOL-021", "SOL-041", "SOL-048"]),
    ("SOC2", "CC7.1", "System Monitoring", ["SOL-017", "SOL-053"]),
    ("SOC2", "CC7.2", "Incident Response", ["SOL-054", "SOL-055"]),
    ("SOC2", "CC8.1", "Change Management", ["SOL-056", "SOL-057", "SOL-058"]),
]
ISO27001 = [
    ("ISO27001", "A.8.3", "Access Restriction", ["SOL-001", "SOL-003", "SOL-007"]),
    ("ISO27001", "A.8.9", "Configuration Management", ["SOL-010", "SOL-011"]),
    ("ISO27001", "A.8.24", "Cryptography", ["SOL-017", "SOL-053"]),
    ("ISO27001", "A.8.25", "Secure Development", ["SOL-005", "SOL-021", "SOL-031", "SOL-041"]),
    ("ISO27001", "A.8.26", "Application Security", ["SOL-048", "SOL-054", "SOL-055", "SOL-056"]),
    ("ISO27001", "A.8.28", "Secure Coding", ["SOL-057", "SOL-058", "SOL-064", "SOL-067"]),
]
OWASP_SCS = [
    ("OWASPSCS", "SCS-01", "Reentrancy", ["SOL-017"]),
    ("OWASPSCS", "SCS-02", "Access Control", ["SOL-001", "SOL-003", "SOL-005", "SOL-007"]),
    ("OWASPSCS", "SCS-03", "Arithmetic", ["SOL-021", "SOL-041"]),
    ("OWASPSCS", "SCS-04", "Unchecked Return Values", ["SOL-048"]),
    ("OWASPSCS", "SCS-05", "Oracle Manipulation", ["SOL-053", "SOL-054"]),
    ("OWASPSCS", "SCS-06", "Flash Loan Protection", ["SOL-055"]),
    ("OWASPSCS", "SCS-07", "Initialization", ["SOL-010", "SOL-011"]),
    ("OWASPSCS", "SCS-08", "Cross-Program Security", ["SOL-031", "SOL-056", "SOL-057"]),
    ("OWASPSCS", "SCS-09", "Event Emission", ["SOL-064"]),
    ("OWASPSCS", "SCS-10", "Upgrade Safety", ["SOL-058", "SOL-067"]),
]
SOLANA_FOUNDATION = [
    ("SolanaFoundation", "SF-01", "Signer Verification", ["SOL-001"]),
    ("SolanaFoundation", "SF-02", "Account Ownership", ["SOL-003", "SOL-007"]),
    ("SolanaFoundation", "SF-03", "PDA Validation", ["SOL-005", "SOL-010"]),
    ("SolanaFoundation", "SF-04", "Integer Safety", ["SOL-021", "SOL-041"]),
    ("SolanaFoundation", "SF-05", "CPI Safety", ["SOL-031", "SOL-056"]),
    ("SolanaFoundation", "SF-06", "Account Closure", ["SOL-011", "SOL-048"]),
    ("SolanaFoundation", "SF-07", "Reentrancy Guards", ["SOL-017"]),
    ("SolanaFoundation", "SF-08", "Authority Management", ["SOL-053", "SOL-054", "SOL-055"]),
]
FRAMEWORKS = {"SOC2": SOC2, "ISO27001": ISO27001, "OWASPSCS": OWASP_SCS, "SolanaFoundation": SOLANA_FOUNDATION}
