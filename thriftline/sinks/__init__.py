"""Writers: result documents, mirrored trees and report tables."""
