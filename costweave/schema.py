"""The billing table contract: declared columns, line item types, population rules."""

from __future__ import annotations

from pyspark.sql import types as T

# The declared columns of the billing table and their types. Names and
# types have to match the delivered reports exactly, partition columns come last.
CONTRACT_TEXT = """
bill_bill_type string
bill_billing_entity string
bill_billing_period_end_date timestamp
bill_billing_period_start_date timestamp
bill_invoice_id string
bill_payer_account_id string
identity_line_item_id string
identity_time_interval string
line_item_availability_zone string
line_item_blended_cost double
line_item_blended_rate string
line_item_currency_code string
line_item_legal_entity string
line_item_line_item_description string
line_item_line_item_type string
line_item_normalization_factor double
line_item_normalized_usage_amount double
line_item_operation string
line_item_product_code string
line_item_resource_id string
line_item_tax_type string
line_item_unblended_cost double
line_item_unblended_rate string
line_item_usage_account_id string
line_item_usage_amount double
line_item_usage_end_date timestamp
line_item_usage_start_date timestamp
line_item_usage_type string
product_from_location string
product_from_location_type string
product_instance_type string
product_product_family string
product_product_name string
product_region string
product_storage_class string
product_to_location string
product_to_location_type string
pricing_lease_contract_length string
pricing_public_on_demand_cost double
pricing_public_on_demand_rate string
pricing_rate_id string
pricing_term string
pricing_unit string
reservation_amortized_upfront_cost_for_usage double
reservation_amortized_upfront_fee_for_billing_period double
reservation_effective_cost double
reservation_end_time timestamp
reservation_modification_status string
reservation_normalized_units_per_reservation string
reservation_number_of_reservations string
reservation_recurring_fee_for_usage double
reservation_reservation_a_r_n string
reservation_start_time timestamp
reservation_subscription_id string
reservation_total_reserved_normalized_units string
reservation_total_reserved_units string
reservation_units_per_reservation string
reservation_unused_amortized_upfront_fee_for_billing_period double
reservation_unused_normalized_unit_quantity double
reservation_unused_quantity double
reservation_unused_recurring_fee double
reservation_upfront_value double
savings_plan_amortized_upfront_commitment_for_billing_period double
savings_plan_end_time timestamp
savings_plan_instance_type_family string
savings_plan_offering_type string
savings_plan_payment_option string
savings_plan_purchase_term string
savings_plan_recurring_commitment_for_billing_period double
savings_plan_region string
savings_plan_savings_plan_a_r_n string
savings_plan_savings_plan_effective_cost double
savings_plan_savings_plan_rate double
savings_plan_start_time timestamp
savings_plan_total_commitment_to_date double
savings_plan_used_commitment double
resource_tags_user_team string
resource_tags_user_environment string
year string
month string
"""

PARTITION_COLUMNS = ("year", "month")

_TYPES = {
    "string": T.StringType(),
    "double": T.DoubleType(),
    "timestamp": T.TimestampType(),
    "timestamp_ntz": T.TimestampNTZType(),
}

CONTRACT = T.StructType([
    T.StructField(name, _TYPES[kind], True)
    for name, kind in (line.split() for line in CONTRACT_TEXT.split("\n") if line)
])

DATA_COLUMNS = [f.name for f in CONTRACT if f.name not in PARTITION_COLUMNS]

# Optional columns that only some report configurations deliver. They are never assumed;
# ask for a group by name when reading (``read_billing(..., optional=("net",))``).
OPTIONAL_GROUPS = {
    "net": {"line_item_net_unblended_cost": "double", "line_item_net_unblended_rate": "string"},
    "discount": {"discount_bundled_discount": "double", "discount_total_discount": "double"},
    "account_name": {"line_item_usage_account_name": "string"},
    "compute": {"product_tenancy": "string", "product_operating_system": "string"},
}

# The documented line item types.
USAGE = "Usage"
DISCOUNTED_USAGE = "DiscountedUsage"
SP_COVERED = "SavingsPlanCoveredUsage"
SP_NEGATION = "SavingsPlanNegation"
RI_FEE = "RIFee"
SP_RECURRING = "SavingsPlanRecurringFee"
SP_UPFRONT = "SavingsPlanUpfrontFee"
FEE = "Fee"
TAX = "Tax"
CREDIT = "Credit"
REFUND = "Refund"
DISCOUNT = "Discount"
BUNDLED_DISCOUNT = "BundledDiscount"
FLAT_RATE = "FlatRateSubscription"
LINE_ITEM_TYPES = (
    USAGE, DISCOUNTED_USAGE, SP_COVERED, SP_NEGATION, RI_FEE, SP_RECURRING, SP_UPFRONT,
    FEE, TAX, CREDIT, REFUND, DISCOUNT, BUNDLED_DISCOUNT, FLAT_RATE,
)

# Types that adjust a bill rather than consume anything.
NON_CONSUMPTION = (TAX, CREDIT, REFUND, DISCOUNT, BUNDLED_DISCOUNT)
# Types a gross usage figure is made of.
GROSS_USAGE = (USAGE, DISCOUNTED_USAGE, SP_COVERED, SP_NEGATION, SP_RECURRING, SP_UPFRONT,
               RI_FEE, FEE)

# The one line item type on which a column may be filled.
POPULATED_ON = {
    "reservation_amortized_upfront_fee_for_billing_period": RI_FEE,
    "reservation_unused_amortized_upfront_fee_for_billing_period": RI_FEE,
    "reservation_unused_recurring_fee": RI_FEE,
    "reservation_unused_quantity": RI_FEE,
    "reservation_unused_normalized_unit_quantity": RI_FEE,
    "reservation_amortized_upfront_cost_for_usage": DISCOUNTED_USAGE,
    "reservation_recurring_fee_for_usage": DISCOUNTED_USAGE,
    "reservation_effective_cost": DISCOUNTED_USAGE,
    "savings_plan_savings_plan_rate": SP_COVERED,
    "savings_plan_savings_plan_effective_cost": SP_COVERED,
    "savings_plan_amortized_upfront_commitment_for_billing_period": SP_RECURRING,
    "savings_plan_recurring_commitment_for_billing_period": SP_RECURRING,
    "savings_plan_used_commitment": SP_RECURRING,
    "savings_plan_total_commitment_to_date": SP_RECURRING,
}


def contract(optional: tuple[str, ...] = (), extra: dict[str, str] | None = None,
             ntz: bool = False) -> T.StructType:
    """The contract plus optional groups and ``extra`` columns (name -> type name).

    ``ntz=True`` declares timestamps without time zone, for tables written that way.
    Partition columns stay last, as Hive-style layouts expect.
    """
    known = set(CONTRACT.names)
    added: dict[str, str] = {}
    for group in optional:
        added.update(OPTIONAL_GROUPS[group])
    added.update(extra or {})
    fields = [f for f in CONTRACT if f.name not in PARTITION_COLUMNS]
    fields += [T.StructField(n, _TYPES[k], True) for n, k in added.items() if n not in known]
    fields += [f for f in CONTRACT if f.name in PARTITION_COLUMNS]
    if ntz:
        fields = [T.StructField(f.name, T.TimestampNTZType(), True)
                  if isinstance(f.dataType, T.TimestampType) else f for f in fields]
    return T.StructType(fields)
