"""Column functions: classification, formatting, text statistics, file headers and markup."""
