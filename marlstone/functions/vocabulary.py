"""Vocabularies of the question gate and of query expansion."""

# Each table is matched as it stands, in this order.
# Parts of words that make a question one of the domain.
DOMAIN_TERMS = (
    "data privacy", "privacy", "personal data", "personal information", "sensitive personal", "pii", "dpa", "npc", "compliance", "consent", "breach",
    "data subject", "retention", "disposal", "records", "outbound", "transfer", "vendor", "outsourc", "third part", "registr", "profiling",
    "automated decision", "artificial intelligence", " ai ", "dpia", "impact assessment", "dpo", "data protection officer", "legal basis", "lawful",
    "purpose limitation", "security", "penal", "fine", "circular", "advisory", "irr", "bsp", "ra 10173", "10173", "privacy.gov", "npc.gov", "egress",
    "redact", "anonymi", "karapatang", "customer", "collection", "data ng", "basehan", "ahente", "complaint", "reklamo", "itinatago", "itago",
    "pasok", "labas", "privacy officer", "compliance officer", "credit card", "debit card", "card number", "cardholder", "cvv", "cvc",
    "security code", "atm", "pin", "password", "otp", "one-time", "verification code", "agent", "call center", "call centre", "front line",
    "frontline", "teller", "recorded call", "recording", "transcript", "chat log", "screenshot", "employee", "staff", "disclose", "solicit",
    "soliciting", "over the phone", "caller",
)
# Cues of questions on transfers, and the terms they add.
OUTBOUND_CUES = (
    "vendor", "supplier", "third party", "third-party", "outsourc", "cloud", "ibang bansa", "ibang lugar", "abroad", "overseas",
    "outside the philippines", "third country", "cross-border", "cross border", "foreign", "offshore", "ipasa", "ipinapasa", "i-send", "isend",
    "padala", "ibigay", "transfer", "i-disclose", "idisisclose", "baho",
)
OUTBOUND_TERMS = (
    "third", "party", "transferred", "transfer", "recipient", "contractor", "processing", "internationally", "cross", "border", "foreign",
    "disclosed",
)
# Cues of questions on breaches, and the terms they add.
BREACH_CUES = (
    "breach", "leak", "nag-leak", "compromised", "hacked", "data subject", "mga datos", "personal data",
)
BREACH_TERMS = (
    "breach", "compromised", "unauthorized", "affected", "notification", "notify", "incident",
)
# Cues of front-line actions, and the terms they add.
FRONT_LINE_CUES = (
    "recorded call", "recording", "record the call", "call recording", "tape the call", "transcript", "chat log", "screenshot", "conversation with",
    "chat with the", "how long", "retention", "delete the recording", "disclose to the", "read out", "spell out", "write down", "take down",
    "note down", "humingi", "i-ask", "magtanong", "ibigay", "kayang", "ask the customer", "ask the client", "solicit",
)
FRONT_LINE_TERMS = (
    "sensitive", "personal", "information", "financial", "adequate", "excessive", "purpose", "declared", "legitimate", "strict", "confidentiality",
    "employees", "agents", "representatives", "security", "measures", "reasonable", "appropriate", "consent", "lawful", "unauthorized", "processing",
    "penalized", "breach", "notification", "data", "protection", "officer", "retention", "retained", "collected",
)
# Cues of card credentials, and the terms they add.
CREDENTIAL_CUES = (
    "cvv", "cvc", "cvv2", "cid", "security code", "card verification", "likod ng credit card", "back of the card", "back of their card",
    "cardholder data", "card number", "credit card", "debit card", " atm pin", "pin code", "personal identification number", "password", "login",
    "log-in", "one-time", "otp", "authenticator", "verification code",
)
CREDENTIAL_TERMS = (
    "sensitive", "authentication", "personal", "information", "financial", "adequate", "excessive", "purpose", "collected", "strict",
    "confidentiality", "employees", "agents", "representatives", "security", "measures", "reasonable", "appropriate", "unlawful", "disclosure",
    "unauthorized", "processing", "penalized", "card", "verification", "value", "pin", "password", "credential", "login", "breach", "notification",
    "72", "hours",
)
# Cues of questions on what data is, and the terms they add.
CLASS_CUES = (
    "sensitive personal", "sensitive?", "considered sensitive", "classified", "is it spi", "spi?", " considered personal information",
    "is personal data", "does it count as", "fall under", "falls under", "covered by", "considered private", "private information",
)
CLASS_TERMS = (
    "sensitive", "personal", "information", "privileged", "prohibited", "consent", "authorization", "lawful", "processing", "financial",
    "definition", "means", "refers",
)
# Cues of questions on registration, and the terms they add.
REGISTRATION_CUES = (
    "mag-register", "magregister", "registro", "register", "registration", "dps", "data processing system", "processing system",
    "seal of registration", "certificate of registration", "notified entity", "privacy.gov.ph/registration",
)
REGISTRATION_TERMS = (
    "registration", "registry", "registered", "register", "certificate", "seal", "processing", "system", "systems", "notification", "notify",
    "circular", "dpo", "accountability", "penal",
)
# Cues of a request that an operational rule decides.
SOLICITATION_CUES = (
    "humingi", "i-ask", "magtanong", "tinanong", "ask", "asking", "request", "solicit", "disclose", "kayang", "ibigay", "pwede", "can i", "can we",
    "can our", "should i", "should we", "allowed", "permit", "bakit", "why", "take down", "write down", "record", "hold on to", "read", "spell",
    "say aloud", "recite", "verify", "confirm",
)
#: (cues, terms) in the order in which terms are added.
EXPANSIONS = ((OUTBOUND_CUES, OUTBOUND_TERMS), (BREACH_CUES, BREACH_TERMS), (FRONT_LINE_CUES, FRONT_LINE_TERMS), (CREDENTIAL_CUES, CREDENTIAL_TERMS), (CLASS_CUES, CLASS_TERMS), (REGISTRATION_CUES, REGISTRATION_TERMS))
