"""Writers: CSV, XLSX, sitemap XML, HTML summary and JSON archives."""
