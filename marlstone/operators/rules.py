"""The catalogue of risk typologies."""

from __future__ import annotations

# Of each typology its id, tier, exposed parties, document and anchor (GAP: no document is held),
# regulator, and its patterns in the order in which they are tried.
RULES = (
    ("structuring", "high", ("bank",), ("RA-9160", "covered transaction"), "AMLC / BSP", (
        r"\bjust under\b[^.]{0,40}\bthreshold\b",
        r"\bbelow the (?:reporting |covered transaction )?threshold\b",
        r"\bunder the threshold\b",
        r"\bsplit (?:the )?(?:deposit|cash|amount|transaction)",
        r"\b(?:split|multiple|several)[^.]{0,40}\bsmall(?:er)? (?:cash )?deposits?\b",
        r"\bbelow the limit\b[^.]{0,30}\bcash\b",
        r"\bmany small\b[^.]{0,30}\bcash\b",
        r"\b\d{1,3}(?:,\d{3})+\b[^.]{0,30}\bcash\b",
        r"\bcash\b[^.]{0,25}\b\d{1,3}(?:,\d{3})+\b",
        r"\bcash (?:deposit|deposits|payments?)\b[^.]{0,40}\b\d",
    )),
    ("rapid_passthrough", "high", ("both",), ("RA-9160", "money laundering"), "AMLC / BSP", (
        r"\b(?:same|within the same) day\b[^.]{0,40}\b(?:transfer|withdraw|remit|sent)\b",
        r"\bimmediately (?:onward |transferred |withdrawn |remitted |sent)\b",
        r"\bin and out\b",
        r"\bquick(?:ly)? pass(?:ing)? (?:through|on)\b",
        r"\bno time\b[^.]{0,30}\b(?:sit|linger|stay)\b[^.]{0,30}\b(?:account|deposit)",
        r"\bsame day\b[^.]{0,40}\b(?:overseas|abroad|international)\b",
    )),
    ("mule_account", "critical", ("both",), ("RA-9160", "covered institution"), "AMLC / BSP", (
        r"\bmoney[- ]mule\b",
        r"\bmule account\b",
        r"\b(?:student|young|unemployed|no income|jobless)\b[^.]{0,60}\b(?:received|receives|accept)\b[^.]{0,40}\bcash\b",
        r"\b(?:received|accepts?)\b[^.]{0,40}\bcash\b[^.]{0,40}\b(?:stranger|unknown|several people|third part)",
        r"\basked (?:them|him|her|the customer)\b[^.]{0,40}\b(?:to )?(?:send|transfer| remit)\b",
        r"\bclose the account\b[^.]{0,40}\bbefore\b",
    )),
    ("third_party_funding", "medium", ("both",), ("RA-9160", "true identity of its clients"), "AMLC / BSP", (
        r"\b(?:payment|deposit|funds?|remittance)\b[^.]{0,50}\b(?:from )?(?:a |an )?(?:third part(?:y|ies)|unknown|unrelated|friend|relative|employer)\b",
        r"\bthird[- ]party (?:deposit|payment|funding|transfer)\b",
        r"\bsource of funds\b[^.]{0,40}\b(?:unclear|unexplained|does not match|inconsistent)\b",
        r"\bdoes not match\b[^.]{0,40}\b(?:profile|declared|income|business)\b",
    )),
    ("cross_border_to_unusual_counterparty", "high", ("bank",), ("GAP", "BSP - Manual of Regulations for Banks and circulars"), "BSP / AMLC", (
        r"\b(?:wire\w*|transfer\w*|remit\w*|send\w*|sent)\b[^.]{0,50}\b(?:abroad|overseas|international|offshore|foreign)\b",
        r"\b(?:abroad|overseas|foreign|offshore)\b[^.]{0,50}\b(?:wire\w*|transfer\w*|remittance|beneficiary)\b",
        r"\bunrelated (?:beneficiary|payee|recipient)\b",
        r"\bbeneficiary\b[^.]{0,40}\bno (?:stated |known )?relationship\b",
    )),
    ("credential_solicitation", "critical", ("both",), ("GAP", "PCI Security Standards Council - PCI DSS"), "PCI SSC / BSP", (
        r"\b(?:cvv|cvc2?|cvcv2|cid|cvn2?|security code|card verification)\b",
        r"\batm pin\b",
        r"\bone[- ]time (?:password|code|otp)\b",
        r"\bask\w*\b[^.]{0,30}\b(?:password|pin|otp|one[- ]time)\b",
        r"\bhumingi\b[^.]{0,40}\b(?:cvv|password|pin|otp)\b",
        r"\b(?:read|give|provide)\b[^.]{0,30}\b(?:the )?(?:password|pin|code)\b[^.]{0,20}\b(?:over|phone|call)\b",
    )),
    ("impersonation_social_engineering", "high", ("customer",), ("RA-11967", "fraud"), "BSP / SEC", (
        r"\b(?:pretend\w*|imposter|impersonat\w+|posing)\b[^.]{0,40}\b(?:bank|officer|employee|police|government|bsp|company)\b",
        r"\bclaimed? to be (?:from )?(?:the )?(?:bank|bsp|rsp|pnb|bdti|bdo|bpi)\b",
        r"\bsos call\b|\bemergency\b[^.]{0,40}\bmoney\b",
        r"\burgent\w*\b[^.]{0,40}\b(?:transfer|send|release|wire)\b",
        r"\bpraying for help\b[^.]{0,40}\b(?:money|funds)\b",
        r"\basking for money\b|\basked for money\b",
    )),
    ("payment_detail_change_by_instruction", "high", ("bank",), ("RA-8792", "electronic data message"), "BSP", (
        r"\b(?:change|update|amend)\b[^.]{0,40}\b(?:bank details|account details|payee details|remittance details)\b",
        r"\bnew (?:bank|account|payee|remittance) details\b",
        r"\b(?:sent|received|requested)\b[^.]{0,30}\bby email\b[^.]{0,50}\b(?:change|update|transfer|credit)\b",
        r"\bverify\b[^.]{0,20}\bby (?:email|text|sms|chat)\b",
    )),
    ("account_takeover_indicators", "high", ("both",), ("RA-8792", "unauthorized"), "BSP", (
        r"\baccount (?:takeover|take over|compromise)\b",
        r"\bnew device\b[^.]{0,50}\b(?:login|sign-?in|access)\b",
        r"\bunfamiliar (?:device|location|ip)\b",
        r"\blogin\b[^.]{0,40}\b(?:from|different) (?:a )?(?:new|different|other)\b[^.]{0,30}\b(?:device|location|country)\b",
        r"\bnew beneficiary\b[^.]{0,40}\b(?:added|created)\b",
    )),
    ("insider_exposure", "high", ("both",), ("RA-10173", "strict confidentiality"), "NPC / BSP", (
        r"\b(?:agent|staff|employee|teller|officer)\b[^.]{0,50}\b(?:personal (?:phone|device|laptop)|own phone|home)\b",
        r"\b(?:photograph|photographing|screenshot|shot)\b[^.]{0,40}\b(?:customer|client|record|account)\b",
        r"\bsharing? customer (?:details|data|information)\b",
        r"\b(?:gave|given|passed?)\b[^.]{0,30}\b(?:customer|client) (?:details|data|information)\b[^.]{0,40}\b(?:friend|family|personal)\b",
    )),
    ("tipping_off_risk", "critical", ("bank",), ("RA-9160", "prohibited from communicating"), "AMLC", (
        r"\btip(?:ping)? ?off\b",
        r"\btell\w*\b[^.]{0,40}\b(?:customer|client)\b[^.]{0,40}\b(?:report|reported|reported to)\b",
        r"\bask\w*\b[^.]{0,30}\b(?:customer|client)\b[^.]{0,30}\bwhether\b[^.]{0,30}\breport\w*\b",
        r"\bconfirm\w*\b[^.]{0,40}\b(?:that )?(?:we|they)\b[^.]{0,30}\breported\b",
    )),
    ("disproportionate_amount_elder", "high", ("customer",), ("RA-10173", "sensitive personal information"), "BSP / NPC", (
        r"\b(?:elderly|old|vulnerable)\b[^.]{0,60}\b(?:guided|directed|told|instructed|coached)\b",
        r"\bon behalf of\b[^.]{0,40}\b(?:customer|client)\b[^.]{0,40}\b(?:elderly|senior)\b",
        r"\b(?:relative|son|daughter|grandchild|neighbou?r|caregiver)\b[^.]{0,60}\b(?:instructing|directing|telling|coaching|dictating|guiding)\b",
        r"\b(?:elderly|senior|vulnerable)\b[^.]{0,60}\b(?:relative|son|daughter|caregiver|neighbou?r)\b[^.]{0,60}\b(?:instructing|directing|telling|coaching|controlling)\b",
    )),
    ("first_party_dispute", "medium", ("both",), ("GAP", "BSP - Manual of Regulations for Banks and circulars"), "BSP", (
        r"\b(?:does ?n[o']t|never|no)\b[^.]{0,30}\brecognis\w+\b[^.]{0,30}\btransaction\b",
        r"\bnever made\b[^.]{0,40}\b(?:transfer|payment|withdrawal|transaction|deposit)\b",
        r"\b(?:did ?n[o']t|did not) make\b[^.]{0,30}\b(?:transfer|payment|withdrawal)\b",
        r"\bwas ?n[o']t me\b",
        r"\bunauthori[sz]ed\b[^.]{0,40}\btransaction\b",
        r"\b(?:first[- ]party|app store fraud|account takeover)\b",
        r"\bdisput\w+\b[^.]{0,40}\b(?:made|authoris\w+|transacted)\b[^.]{0,20}\bby (?:them|him|her)\b",
    )),
    ("merchant_side_deception", "medium", ("customer",), ("RA-11967", "online merchant"), "SEC / DTI", (
        r"\b(?:item|items|order|parcel|package|goods|product)\b[^.]{0,40}\b(?:never (?:arrived|arrives|received)|not (?:arrived|received|delivered)|missing)\b",
        r"\bonline (?:seller|merchant|shop|store)\b[^.]{0,40}\b(?:scam|fraud|fake|not real)\b",
        r"\bprepaid\b[^.]{0,30}\b(?:not|no goods)\b",
    )),
    ("cash_intensity_mismatch", "medium", ("bank",), ("RA-9160", "true identity of its clients"), "BSP / BIR", (
        r"\bcash intensive\b|\balmost entirely (?:in )?cash\b",
        r"\bdeclares?\b[^.]{0,40}\b(?:digital|card|online)\b[^.]{0,40}\bbut\b[^.]{0,40}\bcash\b",
        r"\bundeclared cash\b",
        r"\bno (?:recorded|invoices?) (?:sales|revenue)\b",
    )),
    ("no_source_documentation", "high", ("bank",), ("RA-9160", "true identity of its clients"), "AMLC / BSP", (
        r"\b(?:cannot|can't|unable to|refuses? to|declines? to|will not)\b[^.]{0,40}\b(?:prov(?:ide|ide)|document|explain|justify|support)\b",
        r"\bno documentation\b[^.]{0,40}\b(?:funds|source|purpose)\b",
        r"\bvague (?:explanation|reason|purpose)\b",
    )),
    ("sanctions_or_hit", "critical", ("bank",), ("GAP", "BSP - Manual of Regulations for Banks and circulars"), "BSP / AMLC", (
        r"\b(?:sanction|watchlist|adverse media)\b",
        r"\bscreening hit\b|\bname match\b|\bfalse positive\b[^.]{0,20}\bscreen",
        r"\bterrorist (?:financing|list)\b|\bsdn\b",
    )),
    ("secrecy_breach_customer", "high", ("customer",), ("RA-10173", "strict confidentiality"), "NPC / BSP", (
        r"\b(?:disclos\w+|reveal\w+|leak\w*|shared?)\b[^.]{0,40}\b(?:balance|account details|transaction history)\b[^.]{0,40}\b(?:caller|stranger|wrong|unverified|impersonat)",
        r"\bgave?\b[^.]{0,30}\b(?:balance|details)\b[^.]{0,30}\bto the (?:caller|stranger)\b",
        r"\bwrong (?:number|person|customer)\b[^.]{0,30}\b(?:balance|details|account)\b",
    )),
    ("unregistered_intermediary", "medium", ("both",), ("RA-9160", "covered institution"), "BSP / AMLC", (
        r"\b(?:third[- ]party|intermediary|agent)\b[^.]{0,40}\b(?:receive|receives|receiving|collects?|paid?)\b[^.]{0,40}\b(?:in lieu|instead of|on behalf)\b",
        r"\bunregistered (?:remittance|agent|intermediary|biller)\b",
        r"\b(?:payee|beneficiary)\b[^.]{0,30}\bis not\b[^.]{0,30}\bthe (?:customer|client)\b",
    )),
    ("investment_promise", "high", ("customer",), ("GAP", "SEC - circulars and advisories, including UITAP advisories"), "SEC", (
        r"\b(?:guaranteed?| assured?)\b[^.]{0,25}\b(?:return|profit|yield|interest)\b",
        r"\bdouble (?:your )?(?:money|investment)\b|\bhigh[- ]yield\b[^.]{0,30}\brisk[- ]free\b",
        r"\b(?:investment|forex|crypto|mining)\b[^.]{0,40}\b(?:guaranteed|assured|promises? you|per month)\b",
        r"\bunsolicited (?:investment|offer)\b",
        r"\bnot registered\b[^.]{0,30}\b(?:with the )?(?:sec|commission)\b",
    )),
)
