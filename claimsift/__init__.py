"""claimsift: auditing health-insurance claims for fraud with Spark DataFrames."""
