"""Account bindings and names of the financial ratios.

Everything in this module is a fixed value: which accounts feed which ratio,
per segment and family, and the published code and name of each ratio. A tuple
inside a binding stands for the sum of its accounts. Pass other tables to the
operators to use another chart of accounts.
"""

from __future__ import annotations

# Ratio -> inputs, by family.
CORP = {
    "structure": {
        "EBIT": ("IS_050", "IS_023"),
        "equity_ratio": ("BS_400", "BS_270"),
        "long_term_asset_self_financing_ratio": (("BS_400", "BS_330"), "BS_200"),
        "fixed_asset_self_financing_ratio": (("BS_400", "BS_330"), ("BS_220", "BS_240")),
        "general_solvency_ratio": ("BS_270", "BS_300"),
        "return_on_investment": ("IS_060", "BS_270"),
        "ROIC": ("IS_061", ("BS_320", "BS_338", "BS_400")),
        "basic_earning_power": (("IS_050", "IS_023"), "BS_270"),
        "debt_to_assets_ratio": ("BS_300", "BS_270"),
        "debt_to_equity_ratio": ("BS_300", "BS_400"),
        "short_term_debt_to_assets_ratio": ("BS_310", "BS_270"),
        "interest_coverage_ratio": (("IS_050", "IS_023"), "IS_023"),
        "long_term_debt_to_equity_ratio": ("BS_330", "BS_400"),
        "short_term_debt_to_equity_ratio": ("BS_310", "BS_400"),
    },
    "liquidity": {
        "receivables_to_payables_ratio": (("BS_130", "BS_210"), "BS_300"),
        "receivables_to_total_assets_ratio": (("BS_130", "BS_210"), "BS_270"),
        "debt_to_total_capital_ratio": ("BS_300", "BS_440"),
        "receivables_to_sales_ratio": (("BS_131", "BS_211"), "IS_010"),
        "allowance_for_doubtful_accounts_ratio": (("BS_137", "BS_219"), ("BS_131", "BS_211")),
        "asset_to_debt_ratio": ("BS_270", "BS_300"),
        "current_ratio": (("BS_100", "BS_151"), "BS_310"),
        "quick_ratio": (("BS_100", "BS_151"), "BS_140", "BS_310"),
        "cash_ratio": ("BS_110", "BS_310"),
        "long_term_debt_coverage_ratio": ("BS_200", "BS_330"),
        "debt_to_equity_ratio": ("BS_300", "BS_400"),
        "long_term_debt_to_equity_capital_ratio": ("BS_330", "BS_400"),
        "time_interest_earned": (("IS_050", "IS_023"), "IS_023"),
        "debt_to_tangible_net_worth_ratio": ("BS_300", "BS_400", "BS_227"),
    },
    "risk": {
        "financial_leverage": ("BS_300", "BS_440"),
        "allowance_for_doubtful_accounts_to_total_assets_ratio": (("BS_137", "BS_219"), "BS_270"),
        "permanent_financing_ratio": (("BS_400", "BS_330"), "BS_440"),
    },
    "income": {
        "financial_income_to_net_revenue_ratio": ("IS_021", "IS_010"),
    },
    "profitability": {
        "return_on_assets": ("IS_060", "BS_270"),
        "return_on_fixed_assets": ("IS_060", "BS_220"),
        "return_on_long_term_operating_assets": (
            "IS_060",
            ("BS_240", "BS_210", "BS_220", "BS_230", "BS_260"),
        ),
        "Return_on_equity": ("IS_060", "BS_400"),
        "profitability_of_cost_of_goods_sold": ("IS_030", "IS_011"),
        "price_spread_ratio": ("IS_020", "IS_011"),
        "profitability_of_operating_expenses": ("IS_030", ("IS_025", "IS_026", "IS_011")),
        "Return_on_sales": ("IS_060", "IS_010"),
        "operating_profit_margin": ("IS_030", "IS_010"),
        "net_profit_margin": ("IS_060", "IS_010"),
        "gross_profit_margin": ("IS_020", "IS_010"),
        "return_on_assets_ttm": ("IS_060_TTM", "BS_270"),
        "return_on_equity_ttm": ("IS_060_TTM", "BS_400"),
    },
    "cashflow": {
        "EBITDA": (("IS_050", "IS_023"), "CF_002"),
        "free_cash_flow": ("CF_050", "CF_051", "CF_078"),
        "free_cash_flow_to_operating_cash_flow_ratio": ("free_cash_flow", "CF_050"),
        "cash_debt_coverage_ratio": ("CF_050", "BS_300"),
        "cash_interest_coverage": ("CF_050", "IS_023"),
        "cash_return_on_assets": ("CF_050", "BS_270"),
        "cash_return_on_fixed_assets": ("CF_050", "BS_220"),
        "CFO_to_total_equity": ("CF_050", "BS_400"),
        "cash_flow_from_sales_to_sales": ("CF_050", "IS_010"),
        "cash_flow_margin": ("CF_050", ("IS_010", "IS_021")),
        "earning_quality_ratio": ("CF_050", "IS_060"),
    },
    "average": {
        "return_on_average_assets": ("IS_060", "BS_270"),
        "return_on_average_equity": ("IS_060", "BS_400"),
        "return_on_average_sales": ("IS_060", "IS_010"),
        "Total_Asset_Turnover": ("IS_010", "BS_270"),
    },
    "average_ttm": {
        "return_on_average_assets_ttm": ("IS_060_TTM", "BS_270"),
        "return_on_average_equity_ttm": ("IS_060_TTM", "BS_400"),
    },
    "price": {
        "earning_per_share": ("IS_070",),
        "price_earning_ratio": ("Price", "IS_070"),
        "book_value_per_share": ("IS_070", "IS_060", "BS_400"),
        "price_to_book_ratio": ("Price", "IS_070", "IS_060", "BS_400"),
    },
    "days": {
        "days_sales_outstanding": ("BS_130", "IS_010"),
        "days_payable_outstanding": ("BS_311", "BS_331", "IS_011"),
        "days_inventory_outstanding": ("BS_140", "IS_011"),
        "cash_conversion_cycle": ("BS_130", "BS_311", "BS_331", "BS_140", "IS_011", "IS_010"),
    },
    "turnover": {
        "inventory_turnover_ratio": ("IS_011", ("BS_141",)),
    },
    "growth": {
        "Net_Revenue_Growth": "IS_010",
        "Gross_Profit_Growth": "IS_020",
        "Net_Income_Growth": "IS_060",
        "EBITDA_Growth": "EBITDA",
        "EBIT_Growth": "EBIT",
        "Pre_Tax_Profit_Growth": "IS_050",
        "Accounts_Receivable_Growth": ("BS_131", "BS_211"),
        "Inventory_Growth": "BS_140",
        "Short_Term_Debt_Growth": "BS_310",
        "Long_Term_Debt_Growth": "BS_340",
        "SG&A_Expense_Growth": ("IS_025", "IS_026"),
        "Total_Asset_Growth": "BS_270",
        "Equity_Growth": "BS_400",
        "Liability_Growth": "BS_300",
        "CFO_Growth": "CF_060",
    },
}

# Ratio -> inputs, by family.
BANK = {
    "structure": {
        "EBIT": ("IS_017", "IS_002"),
        "equity_ratio": ("BS_500", "BS_300"),
        "long_term_asset_self_financing_ratio": ("BS_500", ("BS_220", "BS_210", "BS_240")),
        "fixed_asset_self_financing_ratio": ("BS_500", "BS_220"),
        "general_solvency_ratio": ("BS_300", "BS_400"),
        "return_on_investment": ("IS_021", "BS_300"),
        "basic_earning_power": (("IS_017", "IS_002"), "BS_300"),
        "debt_to_assets_ratio": ("BS_400", "BS_300"),
        "debt_to_equity_ratio": ("BS_400", "BS_500"),
        "interest_coverage_ratio": (("IS_017", "IS_002"), "IS_002"),
        "long_term_debt_to_equity_ratio": (("BS_350", "BS_360", "BS_372"), "BS_500"),
    },
    "liquidity": {
        "receivables_to_payables_ratio": ("BS_251", "BS_400"),
        "receivables_to_total_assets_ratio": ("BS_251", "BS_300"),
        "debt_to_total_capital_ratio": ("BS_400", ("BS_400", "BS_500")),
        "receivables_to_sales_ratio": ("BS_251", ("IS_010", "IS_001", "IS_004")),
        "allowance_for_loan_customers_ratio": ("BS_169", "BS_161"),
        "asset_to_debt_ratio": ("BS_300", "BS_400"),
        "current_ratio": (
            ("BS_110", "BS_120", "BS_131", "BS_132"),
            ("BS_370", "BS_371", "BS_373"),
        ),
        "cash_ratio": (("BS_110", "BS_120"), ("BS_370", "BS_371", "BS_373")),
        "long_term_debt_coverage_ratio": (("BS_210", "BS_220", "BS_240"), ("BS_350", "BS_360")),
        "debt_to_equity_ratio": ("BS_400", "BS_500"),
        "long_term_debt_to_equity_capital_ratio": (("BS_350", "BS_360"), "BS_500"),
        "time_interest_earned": (("IS_017", "IS_002"), "IS_002"),
        "debt_to_tangible_net_worth_ratio": ("BS_400", "BS_500", "BS_227"),
        "cost_to_income_ratio": (
            "IS_014",
            ("IS_006", "IS_007", "IS_008", "IS_009", "IS_012", "IS_013"),
        ),
    },
    "risk": {
        "financial_leverage": ("BS_400", "BS_800"),
        "allowance_for_doubtful_accounts_to_total_assets_ratio": ("BS_169", "BS_300"),
    },
    "income": {
        "financial_income_to_net_revenue_ratio": (
            ("IS_004", "IS_007", "IS_008", "IS_009", "IS_010"),
            ("IS_003", "IS_004", "IS_007", "IS_008", "IS_009", "IS_010"),
        ),
    },
    "profitability": {
        "return_on_assets": ("IS_021", "BS_300"),
        "return_on_fixed_assets": ("IS_021", "BS_220"),
        "return_on_long_term_operating_assets": ("IS_021", ("BS_210", "BS_220", "BS_240")),
        "Return_on_equity": ("IS_021", "BS_500"),
        "profitability_of_cost_of_goods_sold": ("IS_015", "IS_005"),
        "profitability_of_operating_expenses": ("IS_017", "IS_014"),
        "Return_on_sales": ("IS_021", ("IS_010", "IS_003", "IS_004")),
        "net_profit_margin": ("IS_021", "IS_001"),
        "operating_profit_margin": ("IS_001", "IS_014", ("IS_010", "IS_003", "IS_004")),
        "gross_profit_margin": ("IS_003", "IS_001"),
        "return_on_assets_ttm": ("IS_021_TTM", "BS_300"),
        "return_on_equity_ttm": ("IS_021_TTM", "BS_500"),
    },
    "cashflow": {
        "EBITDA": (("IS_017", "IS_002"), ("BS_223", "BS_226", "BS_229", "BS_242")),
        "free_cash_flow": ("CF_024", "CF_025", "CF_038"),
        "free_cash_flow_to_operating_cash_flow_ratio": ("free_cash_flow", "CF_024"),
        "cash_debt_coverage_ratio": ("CF_024", "BS_400"),
        "cash_interest_coverage": ("CF_024", "IS_002"),
        "cash_return_on_assets": ("CF_024", "BS_300"),
        "cash_return_on_fixed_assets": ("CF_024", "BS_220"),
        "CFO_to_total_equity": ("CF_024", "BS_500"),
        "cash_flow_from_sales_to_sales": ("CF_024", ("IS_010", "IS_003", "IS_004")),
        "cash_flow_margin": (
            "CF_024",
            ("IS_010", "IS_003", "IS_004", "IS_007", "IS_008", "IS_009"),
        ),
        "earning_quality_ratio": ("CF_024", "IS_021"),
        "net_interest_margin": ("IS_003", ("BS_161", "BS_130", "BS_170")),
    },
    "average": {
        "return_on_average_assets": ("IS_021", "BS_300"),
        "return_on_average_equity": ("IS_021", "BS_500"),
        "return_on_average_sales": ("IS_021", ("IS_010", "IS_003", "IS_004")),
        "Basic_Earning_Power_Ratio": (("IS_017", "IS_002"), "BS_300"),
    },
    "average_ttm": {
        "return_on_average_assets_ttm": ("IS_021_TTM", "BS_300"),
        "return_on_average_equity_ttm": ("IS_021_TTM", "BS_500"),
    },
    "price": {
        "earning_per_share": ("IS_023",),
        "price_earning_ratio": ("Price", "IS_023"),
        "book_value_per_share": ("IS_023", "IS_021", "BS_500"),
        "price_to_book_ratio": ("Price", "IS_023", "IS_021", "BS_500"),
    },
    "days": {},
    "turnover": {
        "cost_of_fund": ("IS_002", ("BS_310", "BS_320", "BS_330", "BS_340", "BS_360")),
    },
    "notes": {
        "current_account_saving_account_ratio": ("BS_330", "Bank_TM_121", "Bank_TM_124"),
        "bad_debt_ratio": ("BS_161", ("Bank_TM_68", "Bank_TM_69", "Bank_TM_70")),
        "non_performing_loan_coverage_ratio": ("BS_169", "Bank_TM_65"),
    },
    "growth": {
        "Net_Income_Growth": "IS_021",
        "Gross_Profit_Growth": "IS_003",
        "Customer_Deposits_Growth": "BS_330",
        "Operating_Expense_Growth": "IS_014",
        "Income_Before_Provision_Growth": "IS_015",
        "Interest_Income_Growth": "IS_003",
        "Pre_Tax_Profit_Growth": "IS_017",
        "Non_Interest_Income_Growth": (
            "IS_006",
            "IS_007",
            "IS_008",
            "IS_009",
            "IS_012",
            "IS_013",
        ),
        "Total_Operating_Income_Growth": "IS_030",
        "Customer_Loans_Growth": "BS_160",
        "Total_Asset_Growth": "BS_300",
        "Equity_Growth": "BS_500",
        "Liability_Growth": "BS_400",
        "outstanding_credit_balance": "BS_200",
    },
}

# Ratio -> inputs, by family.
SECURITIES = {
    "structure": {
        "EBIT": ("IS_090", "IS_052"),
        "equity_ratio": ("BS_400", "BS_270"),
        "long_term_asset_self_financing_ratio": (("BS_410", "BS_340"), "BS_200"),
        "fixed_asset_self_financing_ratio": (("BS_410", "BS_340"), "BS_220"),
        "general_solvency_ratio": ("BS_270", "BS_300"),
        "return_on_investment": ("IS_200", "BS_212"),
        "ROIC": ("IS_100", ("BS_400", "BS_312", "BS_346")),
        "basic_earning_power": (("IS_090", "IS_052"), "BS_270"),
        "debt_to_assets_ratio": ("BS_300", "BS_270"),
        "debt_to_equity_ratio": ("BS_300", "BS_410"),
        "short_term_debt_to_assets_ratio": ("BS_310", "BS_270"),
        "interest_coverage_ratio": (("IS_090", "IS_052"), "IS_052"),
        "long_term_debt_to_equity_ratio": ("BS_340", "BS_410"),
        "short_term_debt_to_equity_ratio": ("BS_310", "BS_410"),
    },
    "liquidity": {
        "receivables_to_payables_ratio": ("BS_117", "BS_300"),
        "receivables_to_total_assets_ratio": ("BS_117", "BS_270"),
        "debt_to_total_capital_ratio": ("BS_300", ("BS_411",)),
        "receivables_to_sales_ratio": (
            "BS_117",
            ("IS_010", "IS_020", "IS_050", "IS_006", "IS_007", "IS_008", "IS_009"),
        ),
        "asset_to_debt_ratio": ("BS_270", "BS_300"),
        "current_ratio": ("BS_100", "BS_310"),
        "cash_ratio": ("BS_111", "BS_310"),
        "long_term_debt_coverage_ratio": ("BS_200", "BS_340"),
        "debt_to_equity_ratio": ("BS_300", "BS_400"),
        "long_term_debt_to_equity_capital_ratio": ("BS_340", "BS_400"),
        "time_interest_earned": ("IS_090", "IS_052"),
        "debt_to_tangible_net_worth_ratio": ("BS_300", "BS_400", "BS_227"),
    },
    "risk": {
        "financial_leverage": ("BS_300", "BS_440"),
        "allowance_for_doubtful_accounts_to_total_assets_ratio": ("BS_129", "BS_270"),
    },
    "income": {
        "financial_income_to_net_revenue_ratio": ("IS_050", "IS_020"),
    },
    "profitability": {
        "return_on_assets": ("IS_200", "BS_270"),
        "return_on_fixed_assets": ("IS_200", "BS_220"),
        "return_on_long_term_operating_assets": (
            "IS_200",
            ("BS_211", "BS_220", "BS_230", "BS_240", "BS_250"),
        ),
        "Return_on_equity": ("IS_200", "BS_400"),
        "profitability_of_operating_expenses": ("IS_200", "IS_040", "IS_040"),
        "Return_on_sales": ("IS_200", "IS_020"),
        "net_profit_margin": ("IS_200", "IS_020"),
        "operating_profit_margin": ("IS_200", "IS_040", "IS_020"),
        "gross_profit_margin": ("IS_040.1", "IS_020"),
        "Total_Asset_Turnover": ("IS_020", "BS_270"),
        "return_on_assets_ttm": ("IS_200_TTM", "BS_270"),
        "return_on_equity_ttm": ("IS_200_TTM", "BS_400"),
    },
    "cashflow": {
        "EBITDA": (("IS_090", "IS_052"), "CF_003"),
        "free_cash_flow": ("CF_060", "CF_061", None),
        "free_cash_flow_to_operating_cash_flow_ratio": ("free_cash_flow", "CF_060"),
        "cash_debt_coverage_ratio": ("CF_060", "BS_300"),
        "cash_interest_coverage": ("CF_060", "IS_052"),
        "cash_return_on_assets": ("CF_060", "BS_270"),
        "cash_return_on_fixed_assets": ("CF_060", "BS_220"),
        "CFO_to_total_equity": ("CF_060", "BS_400"),
        "cash_flow_from_sales_to_sales": ("CF_060", "IS_020"),
        "cash_flow_margin": ("CF_060", "IS_020"),
        "earning_quality_ratio": ("CF_060", "IS_200"),
        "net_interest_margin": ("IS_001", "BS_110"),
    },
    "average": {
        "return_on_average_assets": ("IS_200", "BS_270"),
        "return_on_average_equity": ("IS_200", "BS_400"),
        "return_on_average_sales": ("IS_200", "IS_020"),
        "Basic_Earning_Power_Ratio": (("IS_090", "IS_052"), "BS_270"),
    },
    "average_ttm": {
        "return_on_average_assets_ttm": ("IS_200_TTM", "BS_270"),
        "return_on_average_equity_ttm": ("IS_200_TTM", "BS_400"),
    },
    "price": {
        "earning_per_share": ("IS_501",),
        "price_earning_ratio": ("Price", "IS_501"),
        "book_value_per_share": ("IS_501", "IS_200", "BS_400"),
        "price_to_book_ratio": ("Price", "IS_501", "IS_200", "BS_400"),
    },
    "days": {
        "days_sales_outstanding": ("BS_117", "IS_020"),
        "days_payable_outstanding": ("BS_320", "BS_347", "IS_040"),
    },
    "turnover": {},
    "growth": {
        "Net_Revenue_Growth": "IS_020",
        "Gross_Profit_Growth": "IS_040.1",
        "Net_Income_Growth": "IS_200",
        "EBITDA_Growth": "EBITDA",
        "EBIT_Growth": "EBIT",
        "Pre_Tax_Profit_Growth": "IS_090",
        "Accounts_Receivable_Growth": "BS_117",
        "Short_Term_Debt_Growth": "BS_310",
        "Long_Term_Debt_Growth": "BS_330",
        "SG&A_Expense_Growth": ("IS_061", "IS_062"),
        "Total_Asset_Growth": "BS_270",
        "Equity_Growth": "BS_400",
        "Liability_Growth": "BS_300",
        "CFO_Growth": "CF_060",
    },
}

BINDINGS = {"corp": CORP, "bank": BANK, "securities": SECURITIES}

# Accounts averaged with the prior annual figure when a segment's
# profitability or cash-flow ratio names them on their own.
AVERAGED_PROFITABILITY = {"corp": (), "bank": ("BS_220",), "securities": ("BS_220",)}
AVERAGED_CASHFLOW = {
    "corp": (),
    "bank": ("BS_400", "BS_300", "BS_220", "BS_500"),
    "securities": ("BS_300", "BS_270", "BS_220", "BS_400"),
}
AVERAGED_ALL = {
    "corp": ("BS_300", "BS_270", "BS_220", "BS_400"),
    "bank": ("BS_400", "BS_300", "BS_220", "BS_500"),
    "securities": ("BS_300", "BS_270", "BS_220", "BS_400"),
}

# Growth names that carry no suffix, and those without a quarterly form.
YEARLY_NAME_WITHOUT_SUFFIX = ("Total_Operating_Income_Growth",)
YEARLY_ONLY = ("outstanding_credit_balance",)

# The published table of ratios (ratio_name, ratio_code, function_name).
RATIO_NAMES = (
    ("Equity Ratio", "ER", "equity_ratio"),
    ("Long Term Asset Self Financing Ratio", "LTASFR", "long_term_asset_self_financing_ratio"),
    ("Fixed Asset Self Financing Ratio", "FASFR", "fixed_asset_self_financing_ratio"),
    ("General Solvency Ratio", "GSR", "general_solvency_ratio"),
    ("Return On Investment", "ROI", "return_on_investment"),
    ("Basic Earning Power", "BEP", "basic_earning_power"),
    ("Debt To Assets Ratio", "DTAR", "debt_to_assets_ratio"),
    ("Debt To Equity Ratio", "DTER", "debt_to_equity_ratio"),
    ("Short Term Debt To Assets Ratio", "STDTAR", "short_term_debt_to_assets_ratio"),
    ("Interest Coverage Ratio", "ICR", "interest_coverage_ratio"),
    ("Long Term Debt To Equity Ratio", "LTDTER", "long_term_debt_to_equity_ratio"),
    ("Short Term Debt To Equity Ratio", "STDTER", "short_term_debt_to_equity_ratio"),
    ("Receivables To Payables Ratio", "RTPR", "receivables_to_payables_ratio"),
    ("Receivables To Total Assets Ratio", "RTTAR", "receivables_to_total_assets_ratio"),
    ("Debt To Total Capital Ratio", "DTTCR", "debt_to_total_capital_ratio"),
    ("Receivables To Sales Ratio", "RTSR", "receivables_to_sales_ratio"),
    ("Allowance For Doubtful Accounts Ratio", "AFDAR", "allowance_for_doubtful_accounts_ratio"),
    ("Asset To Debt Ratio", "ATDR", "asset_to_debt_ratio"),
    ("Current Ratio", "CurrentR", "current_ratio"),
    ("Quick Ratio", "QR", "quick_ratio"),
    ("Cash Ratio", "CashR", "cash_ratio"),
    ("Long Term Debt Coverage Ratio", "LTDCR", "long_term_debt_coverage_ratio"),
    ("Long Term Debt To Equity Capital Ratio", "LTDTECR", "long_term_debt_to_equity_capital_ratio"),
    ("Time Interest Earned", "TIE", "time_interest_earned"),
    ("Debt To Tangible Net Worth Ratio", "DTTNWR", "debt_to_tangible_net_worth_ratio"),
    ("Financial Leverage", "FL", "financial_leverage"),
    ("Allowance For Doubtful Accounts To Total Assets Ratio", "AFDATTAR", "allowance_for_doubtful_accounts_to_total_assets_ratio"),
    ("Permanent Financing Ratio", "PFR", "permanent_financing_ratio"),
    ("Financial Income To Net Revenue Ratio", "FITNRR", "financial_income_to_net_revenue_ratio"),
    ("Return On Assets", "ROA", "return_on_assets"),
    ("Return On Fixed Assets", "ROFA", "return_on_fixed_assets"),
    ("Return On Long Term Operating Assets", "ROLTOA", "return_on_long_term_operating_assets"),
    ("Basic Earning Power Ratio", "BEPR", "Basic_Earning_Power_Ratio"),
    ("Return On Equity", "ROE", "Return_on_equity"),
    ("Profitability Of Cost Of Goods Sold", "POCOGS", "profitability_of_cost_of_goods_sold"),
    ("Price Spread Ratio", "PSR", "price_spread_ratio"),
    ("Profitability Of Operating Expenses", "POOE", "profitability_of_operating_expenses"),
    ("Return On Sales", "ROS", "Return_on_sales"),
    ("Operating Profit Margin", "OPM", "operating_profit_margin"),
    ("Gross Profit Margin", "GPM", "gross_profit_margin"),
    ("Return on Invested Capital", "ROIC", "ROIC"),
    ("EBIT", "EBIT", "EBIT"),
    ("EBITDA", "EBITDA", "EBITDA"),
    ("Free Cash Flow", "FCF", "free_cash_flow"),
    ("Free Cash Flow To Operating Cash Flow Ratio", "FCFTOCFR", "free_cash_flow_to_operating_cash_flow_ratio"),
    ("Cash Interest Coverage", "CIC", "cash_interest_coverage"),
    ("Cash Flow From Sales To Sales", "CFFSTS", "cash_flow_from_sales_to_sales"),
    ("Cash Flow Margin", "CFM", "cash_flow_margin"),
    ("Earning Quality Ratio", "EQR", "earning_quality_ratio"),
    ("Cash Debt Coverage Ratio", "CDCR", "cash_debt_coverage_ratio"),
    ("Cash Return On Assets", "CROA", "cash_return_on_assets"),
    ("Cash Return On Fixed Assets", "CROFA", "cash_return_on_fixed_assets"),
    ("CFO To Total Equity", "CFOTTE", "CFO_to_total_equity"),
    ("Net Interest Margin", "NIM", "net_interest_margin"),
    ("Allowance for loan customers ratio", "ALCR", "allowance_for_loan_customers_ratio"),
    ("Net profit margin", "NPM", "net_profit_margin"),
    ("Current Account Saving Account Ratio", "CASA", "current_account_saving_account_ratio"),
    ("Bad Debt Ratio", "BDR", "bad_debt_ratio"),
    ("Net Revenue Growth YoY", "NRGYoY", "Net_Revenue_Growth_YoY"),
    ("Gross Profit Growth YoY", "GPGYoY", "Gross_Profit_Growth_YoY"),
    ("Net Income Growth YoY", "NIGYoY", "Net_Income_Growth_YoY"),
    ("EBITDA Growth YoY", "EBITDAGYoY", "EBITDA_Growth_YoY"),
    ("EBIT Growth YoY", "EBITGYoY", "EBIT_Growth_YoY"),
    ("Pre Tax Profit Growth YoY", "PTPGYoY", "Pre_Tax_Profit_Growth_YoY"),
    ("Accounts Receivable Growth YoY", "ARGYoY", "Accounts_Receivable_Growth_YoY"),
    ("Inventory Growth YoY", "IGYoY", "Inventory_Growth_YoY"),
    ("Short Term Debt Growth YoY", "STDGYoY", "Short_Term_Debt_Growth_YoY"),
    ("Long Term Debt Growth YoY", "LTDGYoY", "Long_Term_Debt_Growth_YoY"),
    ("SG&A Expense Growth YoY", "SG&AEGYoY", "SG&A_Expense_Growth_YoY"),
    ("Total Asset Growth YoY", "TAGYoY", "Total_Asset_Growth_YoY"),
    ("Equity Growth YoY", "EGYoY", "Equity_Growth_YoY"),
    ("Liability Growth YoY", "LGYoY", "Liability_Growth_YoY"),
    ("CFO Growth YoY", "CFOGYoY", "CFO_Growth_YoY"),
    ("Customer Deposits Growth YoY", "CDGYoY", "Customer_Deposits_Growth_YoY"),
    ("Operating Expense Growth YoY", "OEGYoY", "Operating_Expense_Growth_YoY"),
    ("Income Before Provision Growth YoY", "IBPGYoY", "Income_Before_Provision_Growth_YoY"),
    ("Interest Income Growth YoY", "IIGYoY", "Interest_Income_Growth_YoY"),
    ("Non Interest Income Growth YoY", "NIIGYoY", "Non_Interest_Income_Growth_YoY"),
    ("Total Operating Income Growth", "TOIGYoY", "Total_Operating_Income_Growth"),
    ("Customer Loans Growth YoY", "CLGYoY", "Customer_Loans_Growth_YoY"),
    ("Total Asset Turnover", "TAT", "Total_Asset_Turnover"),
    ("Earning Per Share", "EPS", "earning_per_share"),
    ("Price Earning Ratio", "PE", "price_earning_ratio"),
    ("Price To Book Ratio", "PB", "price_to_book_ratio"),
    ("Book Value Per Share", "BVPS", "book_value_per_share"),
    ("Days Sales Outstanding", "DSO", "days_sales_outstanding"),
    ("Days Inventory Outstanding", "DIO", "days_inventory_outstanding"),
    ("Days Payable Outstanding", "DPO", "days_payable_outstanding"),
    ("Cash Conversion Cycle", "CCC", "cash_conversion_cycle"),
    ("Inventory Turnover Ratio", "ITR", "inventory_turnover_ratio"),
    ("Return On Average Assets", "ROAA", "return_on_average_assets"),
    ("Return On Average Equity", "ROAE", "return_on_average_equity"),
    ("Return On Average Sales", "ROAS", "return_on_average_sales"),
    ("Non-Performing Loan Coverage Ratio", "NPLCR", "non_performing_loan_coverage_ratio"),
    ("Outstanding Credit Balance YoY", "OCBYoY", "outstanding_credit_balance_YoY"),
    ("Cost of Fund", "COF", "cost_of_fund"),
    ("Cost to Income Ratio", "CIR", "cost_to_income_ratio"),
    ("Return On Average Assets (Trailing Twelve Months)", "ROAATTM", "return_on_average_assets_ttm"),
    ("Return On Average Equity (Trailing Twelve Months)", "ROAETTM", "return_on_average_equity_ttm"),
    ("Return On Assets (Trailing Twelve Months)", "ROATTM", "return_on_assets_ttm"),
    ("Return On Equity (Trailing Twelve Months)", "ROETTM", "return_on_equity_ttm"),
    ("Net Revenue Growth QoQ", "NRGQoQ", "Net_Revenue_Growth_QoQ"),
    ("Gross Profit Growth QoQ", "GPGQoQ", "Gross_Profit_Growth_QoQ"),
    ("Net Income Growth QoQ", "NIGQoQ", "Net_Income_Growth_QoQ"),
    ("EBITDA Growth QoQ", "EBITDAQoQ", "EBITDA_Growth_QoQ"),
    ("EBIT Growth QoQ", "EBITGQoQ", "EBIT_Growth_QoQ"),
    ("Pre Tax Profit Growth QoQ", "PTPGQoQ", "Pre_Tax_Profit_Growth_QoQ"),
    ("Accounts Receivable Growth QoQ", "ARGQoQ", "Accounts_Receivable_Growth_QoQ"),
    ("Inventory Growth QoQ", "IGQoQ", "Inventory_Growth_QoQ"),
    ("Short Term Debt Growth QoQ", "STDGQoQ", "Short_Term_Debt_Growth_QoQ"),
    ("Long Term Debt Growth QoQ", "LTDGQoQ", "Long_Term_Debt_Growth_QoQ"),
    ("SG&A Expense Growth QoQ", "SG&AEGQoQ", "SG&A_Expense_Growth_QoQ"),
    ("Total Asset Growth QoQ", "TAGQoQ", "Total_Asset_Growth_QoQ"),
    ("Equity Growth QoQ", "EGQoQ", "Equity_Growth_QoQ"),
    ("Liability Growth QoQ", "LGQoQ", "Liability_Growth_QoQ"),
    ("CFO Growth QoQ", "CFOGQoQ", "CFO_Growth_QoQ"),
    ("Customer Deposits Growth QoQ", "CDGQoQ", "Customer_Deposits_Growth_QoQ"),
    ("Operating Expense Growth QoQ", "OEGQoQ", "Operating_Expense_Growth_QoQ"),
    ("Income Before Provision Growth QoQ", "IBPGQoQ", "Income_Before_Provision_Growth_QoQ"),
    ("Interest Income Growth QoQ", "IIGQoQ", "Interest_Income_Growth_QoQ"),
    ("Non Interest Income Growth QoQ", "NIIGQoQ", "Non_Interest_Income_Growth_QoQ"),
    ("Total Operating Income Growth", "TOIGQoQ", "Total_Operating_Income_Growth_QoQ"),
    ("Customer Loans Growth QoQ", "CLGQoQ", "Customer_Loans_Growth_QoQ"),
)


def growth_name(base: str, suffix: str) -> str:
    """Name of a growth ratio for the suffix YoY or QoQ."""
    if suffix == "YoY" and base in YEARLY_NAME_WITHOUT_SUFFIX:
        return base
    return f"{base}_{suffix}"


def ratio_names() -> dict[str, tuple[str, str]]:
    """Ratio function -> (code, published name)."""
    return {function: (code, name) for name, code, function in RATIO_NAMES}


def account_codes(bindings: dict, families=None) -> list[str]:
    """Account codes a segment's bindings use, in order of first mention."""
    seen: dict[str, None] = {}
    for family, ratios in bindings.items():
        if families is not None and family not in families:
            continue
        for inputs in ratios.values():
            for entry in (inputs,) if isinstance(inputs, str) else inputs:
                for code in entry if isinstance(entry, tuple) else (entry,):
                    if code and code not in ("EBIT", "EBITDA", "free_cash_flow"):
                        seen[code] = None
    return list(seen)
