"""Schemas of requests, references and responses."""

REQUEST = (
    "id string, transaction struct<amount:double,installments:bigint,requested_at:string>,"
    " customer struct<avg_amount:double,tx_count_24h:bigint,known_merchants:array<string>>,"
    " merchant struct<id:string,mcc:string,avg_amount:double>,"
    " terminal struct<is_online:boolean,card_present:boolean,km_from_home:double>,"
    " last_transaction struct<timestamp:string,km_from_current:double>"
)
REQUIRED = (
    "id", "transaction.amount", "transaction.installments", "transaction.requested_at", "customer.avg_amount", "customer.tx_count_24h",
    "customer.known_merchants", "merchant.id", "merchant.mcc", "merchant.avg_amount", "terminal.is_online", "terminal.card_present", "terminal.km_from_home",
)
REFERENCE = "vector array<float>, label string"
RESPONSE = "approved boolean, fraud_score float"
