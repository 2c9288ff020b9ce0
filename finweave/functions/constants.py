"""Word lists, lookup tables, bands and weights."""

# Ratio names by category.
RATIO_CATEGORIES = {
    "liquidity": ("current_ratio", "quick_ratio", "cash_ratio", "operating_cash_ratio", "cash_conversion_cycle"),
    "leverage": ("debt_to_equity", "debt_to_assets", "equity_ratio", "interest_coverage", "debt_service_coverage"),
    "profitability": ("gross_margin", "operating_margin", "net_margin", "ebitda_margin", "roa", "roe", "roic"),
    "efficiency": (
        "asset_turnover", "fixed_asset_turnover", "working_capital_turnover", "inventory_turnover", "receivables_turnover",
        "payables_turnover", "days_inventory", "days_receivables", "days_payables",
    ),
    "growth": ("revenue_growth", "earnings_growth", "asset_growth", "operating_cash_flow_growth"),
}
# Industry benchmarks of six ratios.
INDUSTRY_BENCHMARKS = {
    "Technology": {"current_ratio": 2.0, "debt_to_equity": 0.5, "gross_margin": 0.60, "operating_margin": 0.25, "roe": 0.20, "asset_turnover": 0.8},
    "Healthcare": {"current_ratio": 1.8, "debt_to_equity": 0.6, "gross_margin": 0.65, "operating_margin": 0.20, "roe": 0.15, "asset_turnover": 0.9},
    "Consumer": {"current_ratio": 1.5, "debt_to_equity": 0.8, "gross_margin": 0.40, "operating_margin": 0.15, "roe": 0.18, "asset_turnover": 1.2},
}
# Half-open bands (from, to, what it means); None is unbounded.
INTERPRETATIONS = {
    "current_ratio": ((2.0, None, "Strong liquidity position"), (1.5, 2.0, "Adequate liquidity"), (1.0, 1.5, "Sufficient liquidity"), (0, 1.0, "Potential liquidity concerns")),
    "debt_to_equity": ((0, 0.3, "Very low leverage"), (0.3, 0.5, "Conservative leverage"), (0.5, 1.0, "Moderate leverage"), (1.0, None, "High leverage risk")),
    "gross_margin": ((0.5, 1.0, "Strong pricing power"), (0.35, 0.5, "Healthy margins"), (0.2, 0.35, "Average margins"), (0, 0.2, "Low margins, cost pressure")),
    "roe": ((0.20, None, "Excellent returns"), (0.15, 0.20, "Good returns"), (0.10, 0.15, "Average returns"), (None, 0.10, "Poor returns")),
}
NORMAL_RANGE = "Within normal range"
# Ideals of the health score.
IDEALS = {"current_ratio": 2.0, "quick_ratio": 1.5, "debt_to_equity": 0.4, "gross_margin": 0.5, "operating_margin": 0.25, "net_margin": 0.15, "roe": 0.20, "roa": 0.10, "asset_turnover": 1.0}
# Weights of fundamentals in peer similarity.
SIMILARITY_WEIGHTS = {"revenue": 0.25, "market_cap": 0.25, "gross_margin": 0.15, "roe": 0.15, "debt_to_equity": 0.10, "asset_turnover": 0.10}
# Closed SIC ranges of industries.
SIC_RANGES = {
    "Technology": ((3570, 3579), (3670, 3679), (7370, 7379)),
    "Healthcare": ((2830, 2839), (3840, 3849), (8000, 8099)),
    "Financial": ((6000, 6799),),
    "Consumer": ((2000, 2099), (5200, 5999)),
    "Industrial": ((3400, 3499), (3500, 3599)),
    "Energy": ((1300, 1399), (2900, 2999)),
    "Materials": ((1000, 1099), (2800, 2899), (3300, 3399)),
    "Utilities": ((4900, 4999),),
    "Real Estate": ((6500, 6599),),
    "Telecom": ((4800, 4899),),
}
# Which change of a metric is favourable; context: neither.
FAVOURABLE = {
    "Revenue": "increase", "CostOfRevenue": "decrease", "GrossProfit": "increase", "OperatingExpenses": "decrease", "OperatingIncome": "increase",
    "InterestExpense": "decrease", "IncomeTaxExpense": "decrease", "NetIncome": "increase",
    "CurrentAssets": "increase", "NonCurrentAssets": "context", "Assets": "increase", "CurrentLiabilities": "context",
    "NonCurrentLiabilities": "decrease", "Liabilities": "decrease", "Equity": "increase",
    "OperatingCashFlow": "increase", "InvestingCashFlow": "context", "FinancingCashFlow": "context", "FreeCashFlow": "increase",
}
# Metric names and the tags of facts they come from.
FACT_TAGS = {
    "Assets": "Assets", "CurrentAssets": "AssetsCurrent", "Cash": "CashAndCashEquivalentsAtCarryingValue", "AccountsReceivable": "AccountsReceivableNetCurrent",
    "Inventory": "InventoryNet", "PPE": "PropertyPlantAndEquipmentNet", "Liabilities": "Liabilities", "CurrentLiabilities": "LiabilitiesCurrent",
    "LongTermDebt": "LongTermDebtNoncurrent", "Equity": "StockholdersEquity", "Revenue": "Revenues", "RevenueAlt": "SalesRevenueNet",
    "CostOfRevenue": "CostOfRevenue", "GrossProfit": "GrossProfit", "OperatingExpenses": "OperatingExpenses", "OperatingIncome": "OperatingIncomeLoss",
    "InterestExpense": "InterestExpense", "IncomeTaxExpense": "IncomeTaxExpenseBenefit", "NetIncome": "NetIncomeLoss", "EPS": "EarningsPerShareDiluted",
    "OperatingCashFlow": "NetCashProvidedByUsedInOperatingActivities", "InvestingCashFlow": "NetCashProvidedByUsedInInvestingActivities",
    "FinancingCashFlow": "NetCashProvidedByUsedInFinancingActivities", "FreeCashFlow": "FreeCashFlow", "CapEx": "PaymentsToAcquirePropertyPlantAndEquipment",
    "SharesOutstanding": "WeightedAverageNumberOfDilutedSharesOutstanding", "CommonStock": "CommonStockSharesOutstanding",
    "RetainedEarnings": "RetainedEarningsAccumulatedDeficit", "WorkingCapital": "WorkingCapital",
}
FORMS = ("10-K", "10-Q", "8-K")
# Metrics of the three statements.
STATEMENTS = {
    "BS": ("Assets", "CurrentAssets", "Cash", "AccountsReceivable", "Inventory", "PPE", "Liabilities", "CurrentLiabilities", "LongTermDebt", "Equity", "CurrentRatio", "WorkingCapitalCalc", "DebtToEquity"),
    "IS": ("Revenue", "RevenueAlt", "CostOfRevenue", "GrossProfit", "GrossProfitCalc", "OperatingExpenses", "OperatingIncome", "InterestExpense", "IncomeTaxExpense", "NetIncome", "EPS", "GrossMargin", "OperatingMargin", "NetMargin"),
    "CF": ("OperatingCashFlow", "InvestingCashFlow", "FinancingCashFlow", "FreeCashFlow", "CapEx"),
}
# Word lists of chunks (matched as parts of the lower-case text).
FINANCIAL_WORDS = ("revenue", "income", "expense", "profit", "loss", "margin", "cash flow", "assets", "liabilities", "equity", "debt", "earnings", "ebitda", "roi", "roe", "eps")
RISK_WORDS = ("risk", "uncertainty", "volatility", "exposure", "threat", "challenge", "adverse", "negative", "decline", "loss")
FORWARD_WORDS = ("expect", "anticipate", "believe", "intend", "plan", "forecast", "project", "estimate", "will", "may", "could", "should", "potential", "future", "outlook")
# Sentiment lexicons.
POSITIVE = ("profit", "growth", "increase", "improve", "gain", "positive", "strong", "outperform", "exceed", "success", "opportunity", "efficient", "innovative", "breakthrough", "expansion", "recovery", "optimistic", "favorable", "robust")
NEGATIVE = ("loss", "decline", "decrease", "risk", "concern", "challenge", "weak", "underperform", "miss", "failure", "threat", "inefficient", "obsolete", "recession", "downturn", "pessimistic", "unfavorable", "volatile")
UNCERTAIN = ("may", "might", "could", "possibly", "uncertain", "approximately", "believe", "anticipate", "expect", "intend", "seek", "potential", "contingent", "depend", "fluctuate", "variable")
RISK_INDICATORS = ("risk", "exposure", "liability", "contingency", "vulnerability", "threat", "adverse", "material weakness", "going concern", "impairment")
OPPORTUNITIES = ("opportunity", "potential", "growth", "expansion", "innovation")
FORWARD_STATEMENTS = ("will", "expect", "anticipate", "forecast", "project", "intend", "plan", "believe")
# Stress scenarios (name, factor shocks, probability), and the scalar ones.
STRESS = (
    ("Market Crash", {"equity": -0.40, "credit": -0.30, "rates": 0.02}, 0.02),
    ("Interest Rate Shock", {"rates": 0.03, "equity": -0.15, "credit": -0.10}, 0.05),
    ("Credit Crisis", {"credit": -0.25, "equity": -0.20, "rates": -0.01}, 0.03),
    ("Inflation Surge", {"rates": 0.02, "equity": -0.10, "commodities": 0.20}, 0.10),
)
SCALAR_STRESS = (("Market Crash", -0.30), ("Interest Rate Shock", -0.15), ("Credit Crisis", -0.20))
# Weights of the investment signal and scores of severities.
SIGNAL_WEIGHTS = {"forecast": 0.30, "risk": 0.25, "sentiment": 0.20, "anomaly": 0.15, "factor": 0.10}
SEVERITY_SCORES = {"low": 0.8, "medium": 0.5, "high": 0.2, "critical": 0.0}
SEVERITIES = ("low", "medium", "high", "critical")
# Macro series and their categories.
MACRO_SERIES = {
    "fed_funds_rate": "FEDFUNDS", "treasury_10y": "DGS10", "treasury_2y": "DGS2", "treasury_3m": "DGS3MO", "term_spread_10y2y": "T10Y2Y",
    "term_spread_10y3m": "T10Y3M", "real_interest_rate": "REAINTRATREARAT10Y", "cpi_all": "CPIAUCSL", "cpi_core": "CPILFESL", "pce": "PCEPI",
    "pce_core": "PCEPILFE", "inflation_expectations_5y": "T5YIE", "inflation_expectations_10y": "T10YIE", "ppi": "PPIACO", "unemployment_rate": "UNRATE",
    "nonfarm_payrolls": "PAYEMS", "initial_jobless_claims": "ICSA", "continuing_claims": "CCSA", "labor_force_participation": "CIVPART",
    "employment_population_ratio": "EMRATIO", "average_hourly_earnings": "CES0500000003", "job_openings": "JTSJOL", "gdp": "GDP", "real_gdp": "GDPC1",
    "gdp_growth": "A191RL1Q225SBEA", "industrial_production": "INDPRO", "capacity_utilization": "TCU", "retail_sales": "RSXFS", "personal_income": "PI",
    "personal_consumption": "PCE", "personal_savings_rate": "PSAVERT", "housing_starts": "HOUST", "building_permits": "PERMIT",
    "existing_home_sales": "EXHOSLUSM495S", "case_shiller_index": "CSUSHPISA", "mortgage_rate_30y": "MORTGAGE30US", "mortgage_rate_15y": "MORTGAGE15US",
    "ism_manufacturing": "MANEMP", "ism_services": "NMFBAI", "durable_goods_orders": "DGORDER", "business_inventories": "BUSINV",
    "consumer_sentiment": "UMCSENT", "consumer_confidence": "CSCICP03USM665S", "vix": "VIXCLS", "dollar_index": "DTWEXBGS", "sp500": "SP500",
    "corporate_bond_spread": "BAMLC0A0CM", "high_yield_spread": "BAMLH0A0HYM2", "m2_money_supply": "M2SL", "commercial_bank_credit": "TOTBKCR",
    "consumer_credit": "TOTALSL", "bank_lending_standards": "DRTSCILM", "oil_price_wti": "DCOILWTICO", "gold_price": "GOLDPMGBD228NLBM",
    "copper_price": "PCOPPUSDM", "natural_gas": "DHHNGSP", "china_gdp": "NYGDPMKTPCDWLDCHN", "euro_area_gdp": "NAEXKP01EZQ657S", "global_uncertainty": "GEPUCURRENT",
}
MACRO_CATEGORIES = {
    "rates": ("fed_funds_rate", "treasury_10y", "treasury_2y", "treasury_3m", "term_spread_10y2y", "term_spread_10y3m", "real_interest_rate"),
    "inflation": ("cpi_all", "cpi_core", "pce", "pce_core", "ppi", "inflation_expectations_5y", "inflation_expectations_10y"),
    "employment": ("unemployment_rate", "nonfarm_payrolls", "initial_jobless_claims", "labor_force_participation", "average_hourly_earnings"),
    "activity": ("gdp", "real_gdp", "gdp_growth", "industrial_production", "retail_sales", "personal_consumption"),
    "housing": ("housing_starts", "building_permits", "case_shiller_index", "mortgage_rate_30y"),
    "sentiment": ("consumer_sentiment", "consumer_confidence", "vix"),
    "commodities": ("oil_price_wti", "gold_price", "copper_price"),
}
RECESSION_SERIES = {"recession_periods": "USREC", "sahm_rule": "SAHMCURRENT", "smoothed_recession_prob": "RECPROUSM156N", "yield_curve_prob": "THREEFYTP10"}
CONDITION_SERIES = {"chicago_fed_conditions": "NFCI", "st_louis_stress": "STLFSI2", "kansas_city_stress": "KCFSI", "credit_spread_aaa": "AAA10Y", "credit_spread_baa": "BAA10Y", "ted_spread": "TEDRATE"}
NOWCAST_SERIES = {"gdp_now": "GDPNOW", "aruoba_index": "ARUOBA", "weekly_economic_index": "WEI", "chicago_fed_national_activity": "CFNAI"}
# Patterns that open the items of a yearly report (Java and Python alike).
SECTIONS = {
    "item_1": ("Business", r"(?i)item\s*1\.?\s*(?:and\s*1a\.?\s*)?(?:business|description\s*of\s*business)"),
    "item_1a": ("Risk Factors", r"(?i)item\s*1a\.?\s*risk\s*factors"),
    "item_1b": ("Unresolved Staff Comments", r"(?i)item\s*1b\.?\s*unresolved\s*staff\s*comments"),
    "item_2": ("Properties", r"(?i)item\s*2\.?\s*properties"),
    "item_3": ("Legal Proceedings", r"(?i)item\s*3\.?\s*legal\s*proceedings"),
    "item_4": ("Mine Safety Disclosures", r"(?i)item\s*4\.?\s*mine\s*safety\s*disclosures"),
    "item_5": ("Market for Registrant's Common Equity", r"(?i)item\s*5\.?\s*market\s*for\s*registrant"),
    "item_6": ("Selected Financial Data", r"(?i)item\s*6\.?\s*(?:selected|consolidated)\s*financial\s*data"),
    "item_7": ("Management's Discussion and Analysis (MD&A)", r"(?i)item\s*7\.?\s*management['s]?\s*discussion\s*and\s*analysis"),
    "item_7a": ("Quantitative and Qualitative Disclosures About Market Risk", r"(?i)item\s*7a\.?\s*quantitative\s*and\s*qualitative\s*disclosures"),
    "item_8": ("Financial Statements and Supplementary Data", r"(?i)item\s*8\.?\s*financial\s*statements"),
    "item_9": ("Changes in and Disagreements with Accountants", r"(?i)item\s*9\.?\s*changes\s*in\s*and\s*disagreements"),
    "item_9a": ("Controls and Procedures", r"(?i)item\s*9a\.?\s*controls\s*and\s*procedures"),
    "item_9b": ("Other Information", r"(?i)item\s*9b\.?\s*other\s*information"),
    "item_10": ("Directors, Executive Officers and Corporate Governance", r"(?i)item\s*10\.?\s*directors.*executive\s*officers"),
    "item_11": ("Executive Compensation", r"(?i)item\s*11\.?\s*executive\s*compensation"),
    "item_12": ("Security Ownership", r"(?i)item\s*12\.?\s*security\s*ownership"),
    "item_13": ("Certain Relationships and Related Transactions", r"(?i)item\s*13\.?\s*certain\s*relationships"),
    "item_14": ("Principal Accountant Fees and Services", r"(?i)item\s*14\.?\s*principal\s*account.*fees"),
    "item_15": ("Exhibits and Financial Statement Schedules", r"(?i)item\s*15\.?\s*exhibits.*financial\s*statement\s*schedules"),
    "item_16": ("Form 10-K Summary", r"(?i)item\s*16\.?\s*form\s*10-?k\s*summary"),
}
SECTION_ALTERNATES = {
    "item_1": (r"(?i)^business$", r"(?i)description\s*of\s*business"),
    "item_1a": (r"(?i)^risk\s*factors$",),
    "item_7": (r"(?i)md\&a", r"(?i)management.*discussion.*analysis"),
}
