"""Column functions: identifiers, dates, amounts, VAT, parties, line items."""
